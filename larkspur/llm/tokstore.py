"""Token ids in a content-addressed store.

A document's ids (end id appended) are cut into chunks where a rolling hash of the last WINDOW ids
hits a mask, so equal passages give equal chunks. A chunk is named by its SHA-256 and stored once; a
document's recipe lists its chunk names; recipes are sharded in ascending doc_id order, and every
shard's manifest row holds a Merkle root over its recipes, its ids and the ids of the shards before.
Reading verifies chunk names and Merkle roots, and gets per-document checksums by combining those of
chunks, so each chunk is read once however many documents share it.

Files: ``chunks`` (digest, data: little-endian ids of ``width`` bytes), ``recipes`` (shard, at, doc_id,
start in the shard, n_tokens, digests), ``manifest`` (shard, root, n_tokens, start).

Encoding equals the tokenizers library's with add_special_tokens=False: the same vocabulary and merges
run in tiktoken, and a text that spells an added token goes to the library itself.

Defined cases: a null or empty text has the end id alone; null doc_ids come last and stay null;
repeated doc_ids are separate documents, ordered by their recipes; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import NULL_ID, materialize, partitions, texts, tune, whole_groups

WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 4096  #: ids
#: Fixed value: how the byte-level pre-tokeniser cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """The tokenizers library's byte-level BPE, by tiktoken wherever that takes the same merges.

    tiktoken merges by token id; that is the library's order if ids grow along its list of merges.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        plain = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        pre = spec.get("pre_tokenizer") or {}
        if plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            vocab = spec["model"]["vocab"]
            byte = self.byte_letters()
            merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
            made = [vocab[a + b] for a, b in merges]
            left_out = set(added)
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in left_out}
            if made == sorted(set(made)) and len(ranks) == 256 + len(made):
                self.fast = tiktoken.Encoding("larkspur", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def byte_letters() -> dict[str, int]:
        """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in shown]
        return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}

    def ids(self, text: str) -> list[int]:
        if self.fast is None or (self.added and self.added.search(text)):
            return self.lib.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode_batch(self, docs: list[str], end: int) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array([*self.ids(t), end], kind).tobytes() for t in docs]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- chunks


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, width = np.uint64(0x100000001B3), 1
    with np.errstate(over="ignore"):
        while width < WINDOW:  # windows of twice the width, from the ids' left to right
            h = h[: len(h) - width] * base + h[width:]
            base, width = base * base, width * 2
    hits = np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MEAN - 1)) == 0) + WINDOW
    ends, last = [], 0
    while n - last > LEAST:
        k = int(np.searchsorted(hits, last + LEAST))
        last = min(int(hits[k]) if k < len(hits) else n, last + MOST, n)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; the last node of an odd level moves up; no leaves: hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves]
    while len(level) > 1:
        up = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + level[len(level) & ~1 :]
    return level[0]


def _encode(path: str, end: int):
    """Rows of two kinds, dealt by ``deal``: chunks by digest, recipes by where they came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            chunks: dict[bytes, bytes] = {}
            recipes, sizes = [], []
            for ids in enc.encode_batch([t.decode() for t in texts(b)], end):
                at, names = 0, []
                for e in cut_points(np.frombuffer(ids, f"<u{enc.width}")):
                    data = ids[at * enc.width : e * enc.width]
                    name = hashlib.sha256(data).digest()
                    chunks.setdefault(name, data)
                    names.append(name)
                    at = e
                recipes.append(b"".join(names))
                sizes.append(at)
            n, m = len(chunks), len(recipes)
            deal = [int.from_bytes(d[:7], "little") for d in chunks] + [int.from_bytes(hashlib.sha256(r).digest()[:7], "little") + i for i, r in enumerate(recipes)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(deal, pa.int64()),
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), b.column("doc_id").cast(pa.int64())]),
                    pa.array([0] * n + sizes, pa.int64()),
                    pa.array([*chunks, *recipes], pa.binary()),
                    pa.array([*chunks.values(), *[None] * m], pa.binary()),
                ],
                ["deal", "kind", "doc_id", "n_tokens", "digest", "data"],
            )

    return run


ENCODED = "deal long, kind int, doc_id long, n_tokens long, digest binary, data binary"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by kind and digest, drop chunks that equal the one before."""
    last = None
    for b in batches:
        keep = []
        for kind, d in zip(b.column("kind").to_pylist(), b.column("digest").to_pylist(), strict=True):
            keep.append(kind == 1 or d != last)
            last = d
        yield b.filter(pa.array(keep, pa.bool_()))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number a shard's recipes and give the ids before each within the shard."""
    at = start = 0
    for b in batches:
        n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + len(n)), pa.int64()), pa.array(start + upto - n, pa.int64())], [*b.schema.names, "at", "start"])
        at, start = at + len(n), start + int(upto[-1]) if len(n) else start


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merkle root and ids of each shard, from rows sorted by shard and position."""
    shard, leaves, total = None, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "root": pa.array([merkle(leaves)], pa.binary()), "n_tokens": pa.array([total], pa.int64()), "n_docs": pa.array([len(leaves)], pa.int64())})

    for b in batches:
        for s, n, d in zip(b.column("shard").to_pylist(), b.column("n_tokens").to_pylist(), b.column("digests").to_pylist(), strict=True):
            if s != shard:
                if shard is not None:
                    yield row()
                shard, leaves, total = s, [], 0
            leaves.append(hashlib.sha256(n.to_bytes(8, "little") + d).digest())
            total += n
    if shard is not None:
        yield row()


#: the chunk names of a recipe
NAMES = "transform(sequence(0, cast(length(digests) div 32 as int) - 1), i -> substring(digests, i * 32 + 1, 32))"
ROOTS = "shard int, root binary, n_tokens long, n_docs long"


def _shard_roots(recipes: DataFrame) -> DataFrame:
    one = recipes.select("shard", "at", "n_tokens", "digests").repartition(partitions(recipes), "shard").sortWithinPartitions("shard", "at")
    return one.mapInArrow(_roots, ROOTS)


class Store:
    """The written tables of a store; ``width`` is the bytes of an id."""

    def __init__(self, chunks: DataFrame, recipes: DataFrame, manifest: DataFrame, width: int):
        self.chunks, self.recipes, self.manifest, self.width = chunks, recipes, manifest, width


def write_store(docs: DataFrame, tokenizer: str, end: int = 0, shards: int | None = None) -> Store:
    """Encode ``docs`` and write chunks, recipes and manifest to the shared folder."""
    tune(docs.sparkSession)
    parts = partitions(docs)
    rows = docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, end), ENCODED)
    rows = rows.repartition(parts, "deal").sortWithinPartitions("kind", "digest").mapInArrow(_once, ENCODED).drop("deal")
    both = materialize(rows, "tokens", partition_by=("kind",))
    chunks = both.where("kind = 0").select("digest", "data")
    made = both.where("kind = 1").select("doc_id", "n_tokens", F.col("digest").alias("digests"))
    order = [F.coalesce("doc_id", F.lit(NULL_ID)), F.col("doc_id").isNull(), F.col("digests")]
    made = made.repartitionByRange(shards or parts, *order).sortWithinPartitions(*order)
    made = made.mapInArrow(_shard, "doc_id long, n_tokens long, digests binary, at long, start long")
    recipes = materialize(made.withColumn("shard", F.spark_partition_id()), "recipes")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = _shard_roots(recipes).withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return Store(chunks, recipes, materialize(manifest, "manifest"), encoder(tokenizer).width)


# ---------------------------------------------------------------- reading


def _verify_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, n, crc = b.column("digest").to_pylist(), [], []
            for name, data in zip(names, b.column("data").to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != name:
                    raise ValueError("a chunk does not match its name")
                n.append(len(data) // width)
                crc.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return run


def _crc_tables() -> np.ndarray:
    """Tables [k][byte][value]: a CRC-32 after 2^k more zero bytes."""

    def times(op: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= op[i]
            v, i = v >> 1, i + 1
        return out

    op = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        op = [times(op, v) for v in op]  # one zero byte
    tables = np.zeros((44, 4, 256), np.uint32)
    for k in range(44):
        for j in range(4):
            one = np.zeros(256, np.uint32)
            for bit in range(8):
                one[1 << bit : 2 << bit] = one[: 1 << bit] ^ np.uint32(op[8 * j + bit])
            tables[k, j] = one
        op = [times(op, v) for v in op]
    return tables


_tables: list[np.ndarray] = []


def combine(crc: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of pieces, from the pieces' CRCs and sizes in bytes; ``starts`` as in common.runs."""
    if not _tables:
        _tables.append(_crc_tables())
    upto = np.cumsum(size)
    rest = np.repeat(upto[starts[1:] - 1], np.diff(starts)) - upto  # bytes after each piece
    c = crc.astype(np.uint32)
    for k in range(int(rest.max(initial=0)).bit_length()):
        on = (rest >> k) & 1 == 1
        v, t = c[on], _tables[0][k]
        c[on] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
    return np.bitwise_xor.reduceat(c, starts[:-1])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "key", 5000):
        key = t.column("key").to_numpy()
        starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        if t.column("n").null_count:
            raise ValueError("a recipe names a chunk that is not stored")
        n, crc = t.column("n").to_numpy(), t.column("crc").to_numpy()
        first = t.take(pa.array(starts[:-1]))
        total = np.add.reduceat(n, starts[:-1])
        if (total != first.column("n_tokens").to_numpy()).any():
            raise ValueError("a document's chunks do not add up to its recipe")
        for b in pa.table({"shard": first.column("shard"), "doc_id": first.column("doc_id"), "start": first.column("start"), "n_tokens": total, "ids_crc32": combine(crc, 4 * n, starts).astype(np.int64)}).to_batches():
            yield b


def verify(store: Store) -> DataFrame:
    """Manifest rows whose Merkle root, ids, documents or start the recipes do not give; none if all is well."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    again = _shard_roots(store.recipes).select("shard", F.col("root").alias("r"), F.col("n_tokens").alias("n"), F.col("n_docs").alias("d"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("s"))
    both = store.manifest.join(again, "shard", "full_outer")
    return both.where(~(F.col("root").eqNullSafe(F.col("r")) & F.col("n_tokens").eqNullSafe(F.col("n")) & F.col("n_docs").eqNullSafe(F.col("d")) & F.col("start").eqNullSafe(F.col("s")))).select("shard")


def read_digests(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, each chunk checked against its name."""
    if verify(store).limit(1).count():
        raise ValueError("a shard of recipes does not match its manifest")
    info = materialize(store.chunks.mapInArrow(_verify_chunks(store.width), "digest binary, n long, crc long"), "chunk-info")
    shard_start = store.manifest.select("shard", F.col("start").alias("before"))
    rows = store.recipes.select((F.shiftleft(F.col("shard").cast("long"), 40) + F.col("at")).alias("key"), "shard", "doc_id", "start", "n_tokens", F.posexplode(F.expr(NAMES)).alias("pos", "digest"))
    rows = rows.join(info, "digest", "left").drop("digest")
    rows = rows.repartition(partitions(rows), "key").sortWithinPartitions("key", "pos")
    docs = rows.mapInArrow(_documents, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(shard_start, "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(store: Store, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents whose doc_id is in ``wanted`` (column doc_id)."""
    rows = store.recipes.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("shard", "at", "doc_id", F.posexplode(F.expr(NAMES)).alias("pos", "digest"))
    rows = rows.join(store.chunks, "digest").groupBy("shard", "at", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("c"))
    width = store.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["data"] for x in c), f"<u{width}").astype(np.int64) for c in b.column("c").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return rows.select("doc_id", "c").mapInArrow(run, "doc_id long, ids array<long>")
