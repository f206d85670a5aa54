"""Line dedup by a segment-partition edit join.

Lines (stripped of outer white space) of at least SHORT characters are linked when their edit distance
is at most ``threshold(length)`` of the shorter one; shorter lines are linked only when equal. Equal
lines are one class from the start. A line of length l with threshold t is split into t + 1 even
segments, so a line within t edits holds one of them whole, at a place that both lengths and the
segment's number confine to a few positions; these substrings are the probes. Segments and probes meet
as hashed keys with 8-byte line numbers, and only keys where two different lines meet get the lines'
texts, once per surviving key. There pairs are pruned by length and by signatures of character pairs
(an edit changes at most four), and verified by a banded bit-parallel edit distance. A key keeps a
spanning forest of its links. Of every connected class the first line (by doc_id and place) stays and
the others go.

Keys with more lines than BLOCK are compared in pairs of blocks, each block pair in a group of its own:
a line goes to as many groups as the key has blocks.

Defined cases: null text has no lines; blank lines belong to no class and stay; a null doc_id counts as
larger than any and stays null; rows that repeat doc_id and text are one document and get the same
result each; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.anchors import BASE, PIECE, U, hashes, keyed, mix, prefix
from larkspur.llm.common import drop, materialize, partitions, texts, tune
from larkspur.llm.components import components

SHORT, EDITS, PER_EDIT = 20, 2, 20
BLOCK = 2000  #: lines of one key compared in one group
WORDS = 4  #: 64-bit words of a signature


def threshold(length: int) -> int:
    """Edits allowed for a line of this length: one for each PER_EDIT characters, EDITS at most."""
    return min(EDITS, length // PER_EDIT)


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """(start, size) of ``count`` even segments; the longer ones come last."""
    base, extra = divmod(length, count)
    out, at = [], 0
    for i in range(count):
        size = base + (i >= count - extra)
        out.append((at, size))
        at += size
    return out


def lines_of(text: bytes) -> list[str]:
    return [x.strip() for x in text.decode().split("\n")]


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line index, is a probe) of all lines' own segments, and of the substrings that may match a line as long or shorter.

    All substrings are hashed together from prefix hashes of the lines laid end to end.
    """
    code = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    c = prefix(mix(code.astype(U) + U(1)))
    n = np.array([len(x) for x in lines], np.int64)
    begin = np.cumsum(n) - n
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(line: np.ndarray, length: np.ndarray, i: int, at: np.ndarray, size: np.ndarray, probe: bool) -> None:
        key = mix(hashes(c, begin[line] + at, size) + U(BASE) * (length * 8 + i).astype(U)) >> U(1)
        out.append((key.astype(np.int64), line, np.full(len(line), probe)))

    for more in range(EDITS + 1):
        length = n - more
        limit = np.minimum(EDITS, length // PER_EDIT)
        for t in range(EDITS + 1):
            line = np.flatnonzero((length >= SHORT) & (limit == t) & (more <= t))
            if not len(line):
                continue
            m = length[line]
            base, extra = m // (t + 1), m % (t + 1)
            for i in range(t + 1):
                size = base + (i >= t + 1 - extra)
                at = i * base + np.maximum(0, i - (t + 1 - extra))
                if more == 0:
                    add(line, m, i, at, size, False)
                low = np.maximum(np.maximum(0, at - i), at + more - (t - i))
                high = np.minimum(np.minimum(m + more - size, at + i), at + more + (t - i))
                for p in range(-i, i + 1):
                    if more or p:
                        ok = (at + p >= low) & (at + p <= high)
                        add(line[ok], m[ok], i, at[ok] + p, size[ok], True)
    key, line, probe = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    return key, line, probe


def keys_of(line: str) -> tuple[list[int], list[int]]:
    """Keys of one line's own segments, and of its probes."""
    key, _, probe = line_keys([line])
    return key[~probe].tolist(), key[probe].tolist()


def line_hash(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def line_number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") >> 2 << 1


# ---------------------------------------------------------------- edit distance


def within(a: str, b: str, limit: int) -> bool:
    """Is the edit distance of ``a`` and ``b`` at most ``limit``: bit vectors of a band around the diagonal.

    Equal ends are cut off first. A column holds the vertical differences of 2 * limit + 1 rows as two
    bit sets; the distance is followed along the diagonal that ends in the last cell, where it can only
    grow, so the search stops once it exceeds the limit.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return False
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    m = len(x)
    diff = np.flatnonzero(x != y[:m])
    head = int(diff[0]) if len(diff) else m
    diff = np.flatnonzero(x[head:][::-1] != y[len(y) - (m - head) :][::-1]) if head < m else diff
    tail = int(diff[0]) if len(diff) else m - head
    a, b = a[head : m - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b) <= limit
    width = 2 * limit + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    rows: dict[str, int] = {}
    for i, c in enumerate(a, 1):  # row i is bit i + limit of a mask, bit i + limit - j of column j
        rows[c] = rows.get(c, 0) | 1 << (i + limit)
    at = 1 << (limit + len(a) - len(b))  # the diagonal that ends in the last cell
    plus = full & ~((1 << (limit + 1)) - 1)  # column 0 grows by one a row below row 0
    minus = distance = 0
    for j, c in enumerate(b, 1):
        equal = (rows.get(c, 0) >> j) & full
        plus, minus = plus >> 1 | top, minus >> 1
        same = (((equal & plus) + plus) ^ plus | equal | minus) & full
        if not same & at:
            distance += 1
            if distance > limit:
                return False
        right, left = (minus | ~(same | plus)) & full, same & plus
        right = right << 1 | 1
        plus, minus = (left << 1 | ~(same | right)) & full, same & right & full
    return True


def signatures(lines: list[str]) -> np.ndarray:
    """Bit sets of the character pairs of each line."""
    out = np.zeros((len(lines), WORDS), np.uint64)
    for r, x in enumerate(lines):
        c = np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)
        bits = np.zeros(WORDS * 64, bool)
        bits[h.astype(np.int64)] = True
        out[r] = np.packbits(bits, bitorder="little").view(np.uint64)
    return out


def linked(lines: list[str], block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among different lines within their threshold; between two blocks only, if given."""
    size = np.array([len(x) for x in lines])
    order = np.argsort(size, kind="stable")
    size = size[order]
    sig = signatures([lines[i] for i in order])
    mine = None if block is None else block[order]
    root = np.arange(len(lines))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    a, b = [], []
    for i in range(len(order)):
        t = threshold(int(size[i]))
        end = int(np.searchsorted(size, size[i] + t, side="right"))
        if end <= i + 1:
            continue
        near = np.bitwise_count(sig[i + 1 : end] ^ sig[i]).sum(1) <= 4 * t
        if mine is not None:
            near &= mine[i + 1 : end] != mine[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            p, q = find(i), find(j)
            if p != q and within(lines[order[i]], lines[order[j]], t):
                root[max(p, q)] = min(p, q)
                a.append(order[i])
                b.append(order[j])
    return np.array(a, np.int64), np.array(b, np.int64)


# ---------------------------------------------------------------- Spark


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, docs, ths, places = [], [], [], []
        for doc, th, text in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), texts(b), strict=True):
            for k, x in enumerate(lines_of(text)):
                if x:
                    names.append(line_hash(x))
                    docs.append(doc)
                    ths.append(th)
                    places.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), pa.array(places, pa.int32())], ["line", "doc", "th", "place"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of the distinct lines of each batch; an id's last bit tells segments from probes."""
    for b in batches:
        seen = list({x for t in texts(b) for x in lines_of(t) if len(x) >= SHORT})
        upto = np.cumsum([len(x) for x in seen])
        at = 0
        while at < len(seen):  # PIECE characters, or a longer line alone
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, side="right")))
            key, line, probe = line_keys(seen[at:end])
            number = np.array([line_number(line_hash(x)) for x in seen[at:end]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(number[line] | probe)], ["key", "id"])
            at = end


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, id) sorted, the distinct (key, line) of keys where two lines and a segment meet.

    A key cut by a batch's edge is kept whole, which costs a look and no result.
    """
    last = None  # key and line that ended the batch before
    for b in batches:
        key, ids = b.column("key").to_numpy(), b.column("id").to_numpy()
        if not len(key):
            continue
        line = ids & ~np.int64(1)
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, line[1:] != line[:-1]]
        cuts = np.flatnonzero(new_key)
        keep = (np.add.reduceat(new.astype(np.int64), cuts) > 1) & (np.minimum.reduceat(ids & 1, cuts) == 0)
        keep[-1] = True
        if last is not None and last[0] == key[0]:
            keep[0] = True
            if last[1] == line[0]:
                new[0] = False
        last = (key[-1], line[-1])
        new &= np.repeat(keep, np.diff(np.r_[cuts, len(key)]))
        yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(line[new])], ["key", "id"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of lines, once for each of their keys and, for keys in blocks, each pair of blocks."""
    for b in batches:
        keys, cells, blocks, lines = [], [], [], []
        for text, items in zip(texts(b), b.column("items").to_pylist(), strict=True):
            own = lines_of(text)
            for x in items:
                line = own[x["place"]]
                for k in x["keys"]:
                    n = k["blocks"]
                    mine = (x["id"] >> 1) % n
                    for other in range(n):
                        keys.append(k["key"])
                        cells.append(min(mine, other) * n + max(mine, other))
                        blocks.append(mine)
                        lines.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cells, pa.int64()), pa.array(blocks, pa.int64()), pa.array(lines, pa.string())], ["key", "cell", "block", "line"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def groups() -> Iterator[tuple[list[str], np.ndarray]]:
        held: list[str] = []
        where: list[int] = []
        now = None
        for b in batches:
            for k, c, m, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (k, c) != now:
                    if len(held) > 1:
                        yield held, np.array(where)
                    held, where, now = [], [], (k, c)
                held.append(x)
                where.append(m)
        if len(held) > 1:
            yield held, np.array(where)

    left, right = [], []
    for lines, block in groups():
        a, b = linked(lines, block if block.min() != block.max() else None)
        left += [line_hash(lines[i]) for i in a.tolist()]
        right += [line_hash(lines[i]) for i in b.tolist()]
        if len(left) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
            left, right = [], []
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def line_links(base: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b): links among the distinct lines of keyed documents, as line hashes; a forest per key."""
    parts = partitions(base)
    keys = base.select("text").mapInArrow(_keys, "key long, id long")
    keys = keys.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(_shared, "key long, id long")
    met = materialize(keys, "line-keys")
    # at most rows / BLOCK keys can be over BLOCK
    big = met.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    met_n = met.join(big, "key", "left").select("id", F.struct("key", F.coalesce("n", F.lit(1)).alias("blocks")).alias("k"))
    wanted = met_n.groupBy("id").agg(F.collect_list("k").alias("keys"))
    items = firsts.join(wanted, "id").groupBy("doc", "th").agg(F.collect_list(F.struct("id", "place", "keys")).alias("items"))
    rows = base.join(items, ["doc", "th"]).select("text", "items").mapInArrow(_fetch, "key long, cell long, block long, line string")
    rows = rows.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell")
    links = materialize(rows.mapInArrow(_join, "a binary, b binary"), "line-links")
    drop(met)
    return links


def line_classes(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (line, doc, th, place) of keyed documents' lines, and the lines of classes with more
    than one occurrence: (line, class_doc, class_th, class_place), the class's first occurrence."""
    seen = materialize(base.select("doc", "th", "text").mapInArrow(_occurrences, "line binary, doc long, th long, place int"), "lines")
    here = F.struct("doc", "th", "place")
    firsts = seen.groupBy("line").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    firsts = materialize(firsts, "line-firsts")
    numbered = firsts.mapInArrow(_number, "id long, doc long, th long, place int")
    found = components(line_links(base, numbered))
    tagged = firsts.join(found, F.col("line") == F.col("node"), "left").select("line", "first", "last", F.coalesce("component", "line").alias("class"), F.col("component").isNotNull().alias("near"))
    many = materialize(tagged.where(F.col("near") | (F.col("first") < F.col("last"))), "line-many")
    heads = many.groupBy("class").agg(F.min("first").alias("head"))
    out = many.join(heads, "class").select("line", F.col("head.doc").alias("class_doc"), F.col("head.th").alias("class_th"), F.col("head.place").alias("class_place"))
    return seen, materialize(out, "line-classes")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [line_number(x) for x in b.column("line").to_pylist()]
        first = b.column("first")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(first.field(i) for i in range(3))], ["id", "doc", "th", "place"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, kept_hash, kept_text = [], [], [], []
        for text, places in zip(texts(b), b.column("gone").to_pylist(), strict=True):
            raw = text.split(b"\n")
            out = set(places or ())
            kept = b"\n".join([x for k, x in enumerate(raw) if k not in out]) if out else text
            n.append(sum(1 for x in lines_of(text) if x))
            gone.append(len(out))
            kept_hash.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode())
        cols = [b.column(c) for c in b.schema.names if c not in ("text", "gone")]
        names = [c for c in b.schema.names if c not in ("text", "gone")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_hash, pa.string()), pa.array(kept_text, pa.string())], [*names, "n_lines", "n_removed", "kept_sha256", "kept_text"])


def _marks(base: DataFrame) -> DataFrame:
    """(doc, th, classes, gone): classes of a document's lines that occur elsewhere, and the places to drop."""
    seen, many = line_classes(base)
    away = (F.col("doc") != F.col("class_doc")) | (F.col("th") != F.col("class_th")) | (F.col("place") != F.col("class_place"))
    again = seen.join(many, "line").select("doc", "th", F.struct("place", "class_doc", "class_place", away.alias("repeat")).alias("c"))
    marks = again.groupBy("doc", "th").agg(F.array_sort(F.collect_set("c")).alias("classes"))
    return marks.withColumn("gone", F.expr("transform(filter(classes, c -> c.repeat), c -> c.place)"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with repeated lines gone from text and n_chars (if there) the new length."""
    tune(docs.sparkSession)
    rows = keyed(docs, row=True)
    marks = _marks(rows)
    names = docs.columns
    kind = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row")
            fields = dict(zip(names, row.flatten(), strict=True))
            new = []
            old = [(t or "").encode() for t in fields["text"].to_pylist()]
            for text, places in zip(old, b.column("gone").to_pylist(), strict=True):
                out = set(places or ())
                new.append(b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k not in out]).decode() if out else text.decode())
            changed = np.array([bool(p) for p in b.column("gone").to_pylist()], bool)
            fields["text"] = pc.if_else(pa.array(changed), pa.array(new, pa.string()), fields["text"].cast(pa.string()))
            if "n_chars" in fields:
                sizes = pa.array([len(x) for x in new], pa.int64()).cast(fields["n_chars"].type)
                fields["n_chars"] = pc.if_else(pa.array(changed), sizes, fields["n_chars"])
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(fields.values()), list(fields))], ["row"])

    out = rows.join(marks, ["doc", "th"], "left").select("row", "gone").mapInArrow(run, T.StructType([T.StructField("row", kind)]))
    return out.select("row.*")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256, kept_text, classes for every row of ``docs``.

    ``classes`` lists, for lines with an equal or near line elsewhere, place, and class_doc and
    class_place of the class's first line.
    """
    tune(docs.sparkSession)
    base = keyed(docs)
    marks = _marks(base)
    rows = base.join(marks, ["doc", "th"], "left").select("doc_id", "text", "gone", F.expr("transform(classes, c -> struct(c.place, c.class_doc, c.class_place))").alias("classes"))
    kinds = "doc_id long, classes array<struct<place: int, class_doc: long, class_place: int>>, n_lines long, n_removed long, kept_sha256 string, kept_text string"
    return rows.mapInArrow(_apply, kinds).select("doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text", "classes")
