"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. Every
distinct fingerprint therefore emits all values within r bits of itself, and fingerprints that meet in
a value are linked. Values are shuffled by a key made of parities of groups of bits: the values around
a fingerprint fall into few keys (each flip changes one parity), so a fingerprint is sent once to each
such key, and the task that owns the key makes exactly the values that belong to it, sorts them and
finds those that occur twice. Colliding pairs are verified; of a value's fingerprints each is linked
to the least alone, a key keeps a spanning forest of its links, and links of a member to several roots
are moved on to the least of these before any join, so a dense group gives about as many links as it
has members, never all pairs. Equal fingerprints are one before anything is emitted.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; a text
of fewer words than a shingle hashes whole; a null doc_id stays null and counts as larger than any;
repeated rows share a component; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import NULL_ID, drop, materialize, partitions, texts, tune, whole_groups
from larkspur.llm.components import components

BITS = 64
AT_ONCE = 1 << 16  #: shingles hashed at a time
VALUES = 500_000  #: ball values a key holds on average
AT_MOST = 1 << 23  #: ball values made and sorted at a time


def _byte_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64, repeats counted."""
    import xxhash

    h = xxhash.xxh64_digest
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.r_[0, gaps + 1]
    ends = np.r_[gaps, len(joined)]
    n = len(words) - shingle + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, AT_ONCE):
        s, e = starts[at : min(at + AT_ONCE, n)].tolist(), ends[at + shingle - 1 : min(at + AT_ONCE, n) + shingle - 1].tolist()
        digests = np.frombuffer(b"".join([h(joined[i:j], seed) for i, j in zip(s, e, strict=True)]), np.uint8).reshape(-1, 8)
        if len(digests) < 600:
            counts += np.unpackbits(digests, axis=1).sum(0, dtype=np.int64)
        else:
            bits = _byte_bits()
            counts += np.concatenate([np.bincount(digests[:, k], minlength=256) @ bits for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Ball:
    """All flips of at most ``radius`` of ``bits`` bits, by the parities that they change."""

    def __init__(self, groups: int, radius: int, bits: int = BITS):
        self.groups = groups
        self.members = [[i for i in range(bits) if i % groups == g] for g in range(groups)]
        self.masks = np.array([sum(1 << i for i in m) for m in self.members], np.uint64)
        flips: dict[int, list[int]] = {}
        for k in range(radius + 1):
            for flipped in itertools.combinations(range(bits), k):
                key = 0
                for i in flipped:
                    key ^= 1 << (i % groups)
                flips.setdefault(key, []).append(sum(1 << i for i in flipped))
        self.flips = {k: np.array(v, np.uint64) for k, v in flips.items()}
        self.changes = np.array(sorted(flips), np.int64)

    def parity(self, fp: np.ndarray) -> np.ndarray:
        odd = np.bitwise_count(fp[:, None] & self.masks).astype(np.int64) & 1
        return odd @ (1 << np.arange(self.groups))


def forest(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Least reachable index of each of n nodes, given links between indices."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[first], root[second])
        np.minimum.at(root, first, low)
        np.minimum.at(root, second, low)
        root = root[root]
        if (root == before).all():
            return root


def meet(fp: np.ndarray, change: np.ndarray, ball: Ball, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) of a spanning forest among the fingerprints of one key that share a value of it.

    The root of a tree is its least fingerprint, so that a dense group has the same few roots in all its keys.
    Values are made and sorted in passes, dealt by hash, so that memory stays bounded however many
    fingerprints a key has.
    """
    order = np.lexsort((fp, change))
    fp, change = fp[order], change[order]
    rank = np.empty(len(fp), np.int64)
    by_fp = np.argsort(fp.astype(np.int64), kind="stable")  # as Spark orders longs
    rank[by_fp] = np.arange(len(fp))
    total = sum(len(ball.flips[c]) * n for c, n in zip(*(x.tolist() for x in np.unique(change, return_counts=True)), strict=True))
    passes = -(-total // AT_MOST)
    first, second = [], []
    for p in range(passes):
        lead, owner = _meet(fp, change, rank, ball, radius, p, passes)
        first.append(lead)
        second.append(owner)
    lead, owner = np.concatenate(first), np.concatenate(second)
    root = forest(rank[lead], rank[owner], len(fp))
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[by_fp[root[linked]]], fp[by_fp[linked]]


def _meet(fp: np.ndarray, change: np.ndarray, rank: np.ndarray, ball: Ball, radius: int, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (index of the least, of another fingerprint) of the values of one pass."""
    spread = np.uint64(0x9E3779B97F4A7C15)
    values, owners = [], []
    cuts = np.r_[0, np.flatnonzero(change[1:] != change[:-1]) + 1, len(change)]
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        flips = ball.flips[int(change[s])]
        step = max(1, AT_MOST // len(flips))
        for at in range(s, e, step):
            v = (fp[at : min(e, at + step), None] ^ flips).ravel()
            own = at + np.arange(len(v), dtype=np.int32) // len(flips)
            if turns > 1:
                mine = ((v * spread) >> np.uint64(32)) % np.uint64(turns) == turn
                v, own = v[mine], own[mine]
            values.append(v)
            owners.append(own)
    all_values = np.concatenate(values)
    ordered = np.sort(all_values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[(twice * spread) >> np.uint64(44)] = True
    at = np.flatnonzero(seen[(all_values * spread) >> np.uint64(44)])
    v = all_values[at]
    k = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
    ok = twice[k] == v
    owner, k = np.concatenate(owners)[at[ok]], k[ok]
    order = np.lexsort((rank[owner], k))
    k, owner = k[order], owner[order]
    lead = owner[np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1]][k]
    near = (lead != owner) & (np.bitwise_count(fp[lead] ^ fp[owner]) <= 2 * radius)
    pair = np.unique(lead[near].astype(np.int64) << 32 | owner[near])
    return pair >> 32, pair & 0xFFFFFFFF


def links(distinct: DataFrame, count: int, radius: int = 2) -> DataFrame:
    """Forest links (a, b) among distinct fingerprints (column fp) that differ in at most 2 * radius bits.

    ``count`` fingerprints set how finely values are dealt; the links' components never depend on it.
    """
    ball_size = sum(math.comb(BITS, k) for k in range(radius + 1))
    groups = min(20, max(6, math.ceil(math.log2(max(1, count) * ball_size / VALUES + 1))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(groups, radius)
        for b in batches:
            fp = b.column("fp").to_numpy().astype(np.uint64)
            for at in range(0, len(fp), 1000):
                part = fp[at : at + 1000]
                key = (ball.parity(part)[:, None] ^ ball.changes).ravel()
                yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "fp": pa.array(np.repeat(part, len(ball.changes)).astype(np.int64), pa.int64())})

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(groups, radius)
        for t in whole_groups(batches, "key"):
            keys, fps = t.column("key").to_numpy(), t.column("fp").to_numpy().astype(np.uint64)
            cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                a, b = meet(fps[s:e], ball.parity(fps[s:e]) ^ keys[s], ball, radius)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})

    rows = distinct.select("fp").mapInArrow(emit, "key long, fp long")
    rows = rows.repartition(partitions(distinct), "key").sortWithinPartitions("key")
    return contracted(rows.mapInArrow(collide, "a long, b long").distinct())


def contracted(pairs: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, all of a member's but one moved on to its least neighbour.

    A member that several keys linked to several roots keeps the least; the other roots are linked to
    that, and as the members of a group have the same few roots these links are few.
    """
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    least = materialize(pairs.groupBy("b").agg(F.min("a").alias("m"), F.max("a").alias("most")), "least")
    several = least.where("m < most").select("b", "m")
    moved = pairs.join(several, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct()
    out = materialize(least.select(F.col("m").alias("a"), "b").union(moved).distinct(), "links")
    drop(pairs, least)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    spark = docs.sparkSession
    tune(spark)
    signed = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(signed.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("rep")), "nodes")
    pairs = links(nodes, nodes.count(), radius)
    a = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a"))
    b = nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b"))
    by_rep = pairs.join(a, "a").join(b, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    found = components(by_rep)
    classes = nodes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("c"))
    classes = materialize(classes, "classes")
    drop(pairs, nodes, found)
    return signed.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("c") < NULL_ID, F.col("c")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, without all but the first by (doc_id, text hash) of each component.

    Components are those of fingerprints alone: rows with a null doc_id are separate documents. Of kept
    rows that repeat a doc_id that is not null the one with the least text hash stays.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "rows")
    groups = near_duplicates(numbered.select(F.col("uid").alias("doc_id"), "row.text"), shingle, radius)
    lean = numbered.select("uid", F.col("row.doc_id").cast("long").alias("d"), F.xxhash64("row.text").alias("th"))
    lean = lean.join(groups.select(F.col("doc_id").alias("uid"), F.col("component_id").alias("c")), "uid")
    first = Window.partitionBy("c").orderBy(F.coalesce("d", F.lit(NULL_ID)), "th", "uid")
    kept = lean.withColumn("n", F.row_number().over(first)).where("n = 1")
    once = Window.partitionBy("d", F.when(F.col("d").isNull(), F.col("uid"))).orderBy("th", "uid")
    kept = materialize(kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("uid"), "kept")
    return numbered.join(kept, "uid", "left_semi").select("row.*")
