"""Windows that occur earlier in the corpus, found through content-chosen anchors.

Both duplicate-span operators ask the same question: which windows of W consecutive symbols (bytes or
words) also start earlier? Each window picks the k-gram with the least hash in it, its anchor, so equal
windows pick equal k-grams at equal places, and consecutive windows that share an anchor make one row,
a run. The steps:

1. ``runs_of``: one row per run; inside a batch, runs with equal content after the first are already
   settled as duplicates, so a passage that very many documents share leaves each batch once. Each is
   compared with the run before it of its content.
2. ``settled``: rows dealt and sorted by k-gram; a stream per task with constant state drops k-grams
   that occur once, pairs runs whose whole content occurred before with the run before them, and leaves
   the runs whose k-gram also occurs in other surroundings. K-grams with many different contents (found in a sample of
   contents, which changes how rows are dealt and nothing else) are dealt by content.
3. ``contexts``: the symbols of those runs are fetched from the texts. K-grams with more runs than a
   fair share of a task are dealt on by the content of single windows, and again equal windows leave a
   batch once.
   The pairs' first texts are fetched there too, joined where neighbouring runs have neighbouring pairs,
   and sent to the second documents. A run is the first of one pair at most, so none is asked often.
4. The operator decides window by window within a group (``resolve``), by its own method.
5. ``verify``: where the spans are cut out, each text is compared with those it was paired with.

Where an operator asks for it, copies of whole texts go first (``whole_copies``): every window of a copy starts
earlier, and so does in its first text every window that others share with it, so only first texts take
the steps above. Copies meet by SHA-256, and each is compared with its first.

Nothing is dropped or capped: a run is settled either by equal content or by comparing its windows, and
equal hashes are never taken for equal texts.

Documents are known by (doc, th): doc_id, and a hash of the text where doc_ids repeat. Rows with one
doc_id and one text are one document; different texts under one doc_id do not remove from each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import NULL_ID, drop, marked, materialize, partitions, texts, trimmed, whole_groups

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SAMPLE = 16  #: one in so many contents tells which k-grams are frequent
PIECE = 1 << 20  #: symbols worked on at a time
PART = 1 << 18  #: symbols whose runs are chosen at a time; longer documents go in overlapping pieces
HELD = 50_000  #: contexts held at a time, those of one document apart

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = []
        for b in (BASE, inverse):
            p = np.full(size, b, U)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers: the hash of [i, i + l) is (c[i + l] - c[i]) * B^-i."""
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=c[1:])
    return c


def hashes(c: np.ndarray, i: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return (c[i + size] - c[i]) * powers(len(c))[1][i]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


@dataclass(frozen=True)
class Spec:
    """window and gram in symbols; own: a window also repeats an earlier one of its own document."""

    window: int
    gram: int
    own: bool


def anchor_runs(values: np.ndarray, bounds: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """Runs of documents laid end to end (cut at ``bounds``): document, start, windows, anchor, k-gram, content."""
    w, k = spec.window, spec.gram
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U), np.zeros(0, U))
    if len(values) < w:
        return empty
    c = prefix(values)
    gram = mix((c[k:] - c[:-k]) * powers(len(c))[1][: len(values) - k + 1])
    least = sliding_min((gram & U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U), w - k + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    i = np.flatnonzero(bounds[1:][doc] - np.arange(len(least)) >= w)
    if not len(i):
        return empty
    anchor, doc = (least[i] & U(0xFFFFFFFF)).astype(np.int64), doc[i]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    n = np.diff(np.r_[first, len(i)])
    start, anchor, doc = i[first], anchor[first], doc[first]
    content = mix(hashes(c, start, n + (w - 1)) + U(0xD6E8FEB86659FD93) * ((anchor - start) * 256 + n).astype(U))
    return doc, start - bounds[doc], n, anchor - start, gram[anchor], content


def merged(doc: np.ndarray, th: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of each document joined."""
    if not len(doc):
        return doc, th, start, size
    o = np.lexsort((start, th, doc))
    doc, th, start, end = doc[o], th[o], start[o], start[o] + size[o]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]
    # running maximum of ends within a document: lift each document above the one before
    lift = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    cut = np.r_[True, (start + lift)[1:] > reach[:-1]] | new
    at = np.flatnonzero(cut)
    return doc[at], th[at], start[at], (reach - lift)[np.r_[at[1:], len(doc)] - 1] - start[at]


def aligned(pair: tuple[np.ndarray, ...], start: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans equal to those at ``other`` in the text they are paired with, joined where both go on: a row of each, its start, size."""
    order = np.lexsort((start - other, *pair))
    change = np.arange(len(order)) == 0
    for x in (start - other, *pair):
        change[1:] |= x[order][1:] != x[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(change) - 1
    found, _, at, n = merged(group, 0 * group, start, size)
    return order[np.flatnonzero(change)][found], at, n


def repeated(doc: np.ndarray, th: np.ndarray, start: np.ndarray, new: np.ndarray, own: bool) -> np.ndarray:
    """Of rows sorted by class, doc, th, start (``new``: a class begins), those that have an earlier equal."""
    if not len(doc):
        return np.zeros(0, bool)
    index = np.arange(len(doc))
    first = np.maximum.accumulate(np.where(new, index, 0))
    dup = doc > doc[first]
    if own:
        change = new | np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]
        mine = np.maximum.accumulate(np.where(change, index, 0))
        dup |= start > start[mine]
    return dup


# ---------------------------------------------------------------- 1: runs of a batch

RUNS = "h long, content long, doc long, th long, at long"
CHECKS = "kind int, h long, doc long, th long, at long, size long, from_doc long, from_th long, from_at long"
SPAN, RUN, PAIR = range(3)  #: a duplicate span; a run to compare; a span that equals the one at from_at
Slices = Callable[[bytes], Callable[[int, int], bytes]]  #: of a text, the function that gives the bytes of (start, size)


class Differ(ValueError):
    def __init__(self):
        super().__init__("two different strings have one hash")


def pack(start: np.ndarray, anchor: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start << 16) | (anchor << 8) | n


def runs_of(symbols: Callable[[bytes], np.ndarray], slices: Slices, spec: Spec):
    """Batches (doc, th, text) to RUNS; a row with no windows is a settled span, ``content`` its length."""

    def pieces(batch: list[bytes]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
        rows, offsets, arrays, total = [], [], [], 0
        for r, t in enumerate(batch):
            s = symbols(t)
            for at in range(0, max(1, len(s) - spec.window + 1), PART):
                part = s[at : at + PART + spec.window - 1]
                if len(part) < spec.window:
                    continue
                if total and total + len(part) > PART:
                    yield rows, offsets, arrays
                    rows, offsets, arrays, total = [], [], [], 0
                rows.append(r)
                offsets.append(at)
                arrays.append(part)
                total += len(part)
        if rows:
            yield rows, offsets, arrays

    def compare(batch: list[bytes], row: np.ndarray, start: np.ndarray, size: np.ndarray, second: np.ndarray) -> None:
        """Each run at ``second`` with the run before it."""
        if not len(second):
            return
        cut: dict[int, Callable[[int, int], bytes]] = {}
        a, b, x, y = row[second - 1], row[second], start[second - 1], start[second]
        k, at, n = aligned((a, b), y, x, size[second])
        for i, j, from_at, to_at, length in zip(a[k].tolist(), b[k].tolist(), (at - (y - x)[k]).tolist(), at.tolist(), n.tolist(), strict=True):
            for r in (i, j):
                if r not in cut:
                    cut[r] = slices(batch[r])
            if cut[i](from_at, length) != cut[j](to_at, length):
                raise Differ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, ths = b.column("doc").to_numpy(), b.column("th").to_numpy()
            found, batch = [], texts(b)
            for rows, offsets, arrays in pieces(batch):
                bounds = np.r_[0, np.cumsum([len(a) for a in arrays])]
                d, start, n, anchor, h, content = anchor_runs(np.concatenate(arrays), bounds, spec)
                r = np.array(rows)[d]
                found.append((h.astype(np.int64), content.astype(np.int64), docs[r], ths[r], start + np.array(offsets)[d], n, anchor, r))
            if not found:
                continue
            h, content, doc, th, start, n, anchor, row = (np.concatenate(x) for x in zip(*found, strict=True))
            o = np.lexsort((start, th, doc, content, h))
            h, content, doc, th, start, n, anchor, row = (x[o] for x in (h, content, doc, th, start, n, anchor, row))
            new = np.r_[True, (h[1:] != h[:-1]) | (content[1:] != content[:-1])] if len(h) else np.zeros(0, bool)
            dup = repeated(doc, th, start, new, spec.own)
            compare(batch, row, start, n + spec.window - 1, np.flatnonzero(dup))
            sd, sth, ss, size = merged(doc[dup], th[dup], start[dup], n[dup] + spec.window - 1)
            deal = mix((sd * 31 + ss).astype(U)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "h": np.r_[h[~dup], deal],
                    "content": np.r_[content[~dup], size],
                    "doc": np.r_[doc[~dup], sd],
                    "th": np.r_[th[~dup], sth],
                    "at": np.r_[pack(start, anchor, n)[~dup], pack(ss, 0 * ss, 0 * ss)],
                }
            )

    return run


# ---------------------------------------------------------------- 2: equal contents, k-grams that occur once


def settled(spec: Spec):
    """RUNS and ``hot``, sorted by all columns, to CHECKS: spans, pairs, and the runs that are left to compare.

    A hot k-gram is dealt by content and known to occur in several surroundings.
    """

    def rows(kind: int, h: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, size: np.ndarray, *pair: np.ndarray) -> pa.RecordBatch:
        names = ["h", "doc", "th", "at", "size", "from_doc", "from_th", "from_at"]
        return pa.RecordBatch.from_pydict({"kind": np.full(len(h), kind, np.int32)} | dict(zip(names, (h, doc, th, at, size, *(pair or (0 * doc,) * 3)), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first row of the last class, and of the last document in it
        last = (0, 0, 0)  # doc, th, at of the last row
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "content", "doc", "th", "at", "hot")]
            passing = cols[4] & 255 == 0
            h, content, doc, th, at, hot = (x[passing] for x in cols)
            yield rows(SPAN, h, doc, th, at >> 16, content)
            if passing.all():
                continue
            cols = [x[~passing] for x in cols]
            ghosts = 0 if held is None else len(held[0])
            if ghosts:
                cols = [np.r_[g, x] for g, x in zip(held, cols, strict=True)]
            h, content, doc, th, at, hot = cols
            real = np.arange(len(h)) >= ghosts
            new_h = np.r_[True, h[1:] != h[:-1]]
            new = new_h | np.r_[True, content[1:] != content[:-1]]
            dup = repeated(doc, th, at >> 16, new, spec.own)
            cuts = np.flatnonzero(new_h)
            many = np.add.reduceat(new.astype(np.int64), cuts) > 1
            many[-1] = True  # its k-gram may go on in the next batch
            if ghosts:
                many[0] = True
            check = real & ~dup & (np.repeat(many, np.diff(np.r_[cuts, len(h)])) | hot)
            twice = dup[ghosts:]
            before = [np.r_[x, y[ghosts:-1]][twice] for x, y in zip(last, (doc, th, at), strict=True)]
            mine = [x[ghosts:][twice] for x in (h, doc, th, at)]
            yield rows(PAIR, *mine[:3], mine[3] >> 16, (mine[3] & 255) + spec.window - 1, before[0], before[1], before[2] >> 16)
            yield rows(RUN, h[check], doc[check], th[check], at[check], at[check] & 255)
            last = (doc[-1], th[-1], at[-1])
            first = int(np.flatnonzero(new)[-1])
            own = int(np.flatnonzero(new | np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])[-1])
            held = [x[[first, own] if own > first else [first]] for x in cols]

    return run


# ---------------------------------------------------------------- 3: symbols of the runs left

CONTEXTS = "deal long, doc long, th long, at long, size long, payload binary"


def contexts(symbols: Callable[[bytes], np.ndarray], slices: Slices, spec: Spec):
    """Batches (doc, th, text, items, asks) to CONTEXTS; a row with no windows is a span of ``size``, its payload the text it must equal."""
    w = spec.window

    def asked(b: pa.RecordBatch, batch: list[bytes]) -> Iterator[tuple[int, int, int, int, int, bytes]]:
        """The text of the batch's documents that spans of others are paired with."""
        flat = b.column("asks").flatten()
        if not len(flat):
            return
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("asks")).to_numpy(zero_copy_only=False))
        doc, th, at, size, from_at = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("doc", "th", "at", "size", "from_at"))
        cut: dict[int, Callable[[int, int], bytes]] = {}
        k, begin, n = aligned((row, doc, th), from_at, at, size)
        for r, d, t, to, start, length in zip(row[k].tolist(), doc[k].tolist(), th[k].tolist(), (begin - (from_at - at)[k]).tolist(), begin.tolist(), n.tolist(), strict=True):
            if r not in cut:
                cut[r] = slices(batch[r])
            yield (to * 31 + d) % (1 << 62), d, t, to << 16, length, cut[r](start, length)

    def held(out: list[tuple], shared: dict[tuple[int, bytes], list[tuple[int, int, int, int, int]]]) -> pa.RecordBatch:
        for (_, payload), rows in shared.items():
            rows.sort()
            dup = repeated(*(np.array([r[i] for r in rows]) for i in (0, 1, 2)), np.arange(len(rows)) == 0, spec.own).tolist() if len(rows) > 1 else [False]
            for (doc, th, start, anchor, deal), d in zip(rows, dup, strict=True):
                out.append(((start * 31 + doc) % (1 << 62), doc, th, start << 16, w, None) if d else (deal, doc, th, (start << 16) | (anchor << 8) | 1, 0, payload))
        names = ["deal", "doc", "th", "at", "size"]
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        arrays = [pa.array(list(cols[i]), pa.int64()) for i in range(5)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(list(cols[5]), pa.binary())], [*names, "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = texts(b)
            out = list(asked(b, batch))
            shared: dict[tuple[int, bytes], list[tuple[int, int, int, int, int]]] = {}
            n_shared = 0
            for doc, th, text, items in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), batch, b.column("items").to_pylist(), strict=True):
                if len(out) + n_shared > HELD:
                    yield held(out, shared)
                    out, shared, n_shared = [], {}, 0
                s = symbols(text) if items else None
                for x in items:
                    start, anchor, n = x["at"] >> 16, (x["at"] >> 8) & 255, x["at"] & 255
                    if not x["hot"]:
                        out.append((x["h"], doc, th, x["at"], 0, s[start : start + n + w - 1].tobytes()))
                        continue
                    part = s[start : start + n + w - 1]
                    deals = mix(hashes(prefix(mix(part.astype(U) + U(1))), np.arange(n), w) + U(x["h"] & (2**64 - 1))).astype(np.int64).tolist()
                    for j in range(n):
                        shared.setdefault((x["h"], part[j : j + w].tobytes()), []).append((doc, th, start + j, anchor - j, deals[j]))
                    n_shared += n
            yield held(out, shared)

    return run


@dataclass
class Rows:
    """Contexts of whole groups: ``group`` numbers them, ``symbols`` holds their payloads end to end."""

    group: np.ndarray
    doc: np.ndarray
    th: np.ndarray
    start: np.ndarray
    anchor: np.ndarray
    n: np.ndarray
    begin: np.ndarray
    symbols: np.ndarray


SPANS = "doc long, th long, start long, size long, expect binary"


def resolved(resolve: Callable[[Rows], tuple[np.ndarray, ...]], dtype: str):
    """CONTEXTS sorted by deal to SPANS; ``resolve`` returns the duplicate windows' doc, th, start, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "deal", 4000):
            deal, doc, th, at, size = (t.column(c).to_numpy() for c in ("deal", "doc", "th", "at", "size"))
            span = at & 255 == 0
            paired = np.flatnonzero(span & t.column("payload").is_valid().to_numpy())
            if len(paired):
                span[paired] = False
                key = np.stack([x[paired] for x in (doc, th, at, size)])
                paired = paired[np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]]
                expect = t.column("payload").take(pa.array(paired)).combine_chunks()
                yield pa.RecordBatch.from_pydict({"doc": doc[paired], "th": th[paired], "start": at[paired] >> 16, "size": size[paired], "expect": expect})
            d, h, s, n = doc[span], th[span], at[span] >> 16, size[span]
            left = np.flatnonzero(at & 255 > 0)
            if len(left):
                payload = t.column("payload").take(pa.array(left)).to_pylist()
                buffer = np.frombuffer(b"".join(payload), dtype)
                sizes = np.array([len(p) for p in payload]) // buffer.itemsize
                deal, at = deal[left], at[left]
                group = np.cumsum(np.r_[True, deal[1:] != deal[:-1]]) - 1
                more = resolve(Rows(group, doc[left], th[left], at >> 16, (at >> 8) & 255, at & 255, np.cumsum(sizes) - sizes, buffer))
                d, h, s, n = (np.r_[a, b] for a, b in zip((d, h, s, n), more, strict=True))
            d, h, s, n = merged(d, h, s, n)
            yield pa.RecordBatch.from_pydict({"doc": d, "th": h, "start": s, "size": n, "expect": pa.nulls(len(d), pa.binary())})

    return run


# ---------------------------------------------------------------- all steps


def keyed(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, text with the key (doc, th); ``row`` adds the whole row as a struct."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.struct("*").alias("row")] * row).withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    again = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).count().where("count > 1").limit(1).count()
    return base.withColumn("th", F.xxhash64("text") if again else F.lit(0).cast("long"))


def whole_copies(base: DataFrame, least: int, count: Callable[[Column], Column]) -> DataFrame:
    """(doc, th, n) of documents of ``least`` symbols or more whose text a document with a smaller id has; n symbols each."""
    sized = materialize(base.select("doc", "th", F.sha2("text", 256).alias("key"), count(F.col("text")).cast("long").alias("n")).where(F.col("n") >= least), "digests")
    first = sized.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("key", "first")
    copies = materialize(sized.join(first, "key").select("doc", "th", "key", "n", "first"), "copies")
    drop(sized)
    # only texts that have copies are dealt, and joined as written tables, so a text's copies can be split among tasks
    some = marked(base.withColumn("place", F.xxhash64("doc", "th")), copies.select(F.xxhash64("doc", "th").alias("place")), "place").where("is_set")
    late, head = (some.join(copies.where(of).select("doc", "th", "key"), ["doc", "th"]).select("key", F.col("text").alias(name)) for of, name in (("doc > first", "a"), ("doc = first", "b")))
    if late.join(head, "key").where("a <> b").limit(1).count():
        raise Differ
    return copies.where("doc > first").select("doc", "th", "n")


def without(base: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, th, text) of the documents that are not in ``keys``; only those that may be there are dealt."""
    some = marked(base.withColumn("place", F.xxhash64("doc", "th")), keys.select(F.xxhash64("doc", "th").alias("place")), "place").select("doc", "th", "text", "is_set")
    rest = some.where("is_set").join(keys, ["doc", "th"], "left_anti")
    return some.where(~F.col("is_set")).union(rest).select("doc", "th", "text")


def duplicate_spans(docs: DataFrame, spec: Spec, values: Callable[[bytes], np.ndarray], symbols: Callable[[bytes], np.ndarray], slices: Slices, dtype: str, resolve: Callable[[Rows], tuple[np.ndarray, ...]], count: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc, th, spans array<struct<start, size, expect>>) of keyed documents that have duplicate windows.

    ``values`` maps a text to the hashed symbols that choose anchors, ``symbols`` to those compared, ``slices``
    to the text of symbols, ``count``, if copies of whole texts are to go first, to their number. Whoever uses
    the spans must ``verify`` them.
    """
    parts = partitions(docs)
    base = docs.select("doc", "th", "text")
    if base.where("th <> 0").limit(1).count():  # rows that repeat a doc_id and text are one document
        base = base.dropDuplicates(["doc", "th"])
    copies = whole_copies(base, spec.window, count) if count else None
    firsts = without(base, copies) if count else base
    runs = materialize(firsts.select("doc", "th", "text").mapInArrow(trimmed(runs_of(values, slices, spec)), RUNS), "runs")
    limit = max(256, runs.count() // (4 * parts))
    sample = runs.where((F.pmod("content", F.lit(SAMPLE)) == 0) & (F.col("at").bitwiseAND(255) > 0))
    # about 4 * parts keys can pass the limit
    often = sample.groupBy("h").count().where(F.col("count") * SAMPLE > limit).select("h", F.lit(True).alias("hot"))
    dealt = runs.join(F.broadcast(often), "h", "left").select(*runs.columns, F.coalesce("hot", F.lit(False)).alias("hot"))
    dealt = dealt.repartition(parts, F.when(F.col("hot"), F.xxhash64("h", "content")).otherwise(F.col("h")))
    dealt = dealt.sortWithinPartitions("h", "content", "doc", "th", "at")
    found = materialize(dealt.mapInArrow(trimmed(settled(spec)), CHECKS), "settled")
    drop(runs)
    checks = found.where(F.col("kind") == RUN)
    limit = max(64, checks.count() // (2 * parts))
    # at most 2 * parts keys can pass the limit
    hot = checks.groupBy("h").count().where(F.col("count") > limit).select("h", F.lit(True).alias("is_hot"))
    pair = F.col("kind") == PAIR
    item = F.when(~pair, F.struct("h", "at", F.coalesce("is_hot", F.lit(False)).alias("hot")))
    ask = F.when(pair, F.struct("doc", "th", "at", "size", "from_at"))
    place = [F.when(pair, F.col(f"from_{c}")).otherwise(F.col(c)).alias(c) for c in ("doc", "th")]
    left = found.where(F.col("kind") != SPAN).join(F.broadcast(hot), "h", "left").select(*place, item.alias("item"), ask.alias("ask"))
    items = left.groupBy("doc", "th").agg(F.collect_list("item").alias("items"), F.collect_list("ask").alias("asks"))
    rows = base.join(items, ["doc", "th"]).mapInArrow(trimmed(contexts(symbols, slices, spec)), CONTEXTS)
    rows = rows.repartition(parts, "deal").sortWithinPartitions("deal", "doc", "th", "at")
    more = materialize(rows.mapInArrow(trimmed(resolved(resolve, dtype)), SPANS), "spans")
    sure = found.where(F.col("kind") == SPAN).select("doc", "th", F.col("at").alias("start"), "size", F.lit(None).cast("binary").alias("expect"))
    spans = sure.union(more).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "size", "expect")).alias("spans"))
    if count:
        whole = F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("size"), F.lit(None).cast("binary").alias("expect"))
        spans = spans.union(copies.select("doc", "th", F.array(whole).alias("spans")))
    out = materialize(spans, "doc-spans")
    drop(found, more)
    return out


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n symbols lie in a span."""
    if not spans:
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    start = np.array([s["start"] for s in spans])
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.array([s["size"] for s in spans]), -1)
    return np.cumsum(edge[:-1]) > 0


def verify(cut: Callable[[int, int], bytes], spans: list[dict] | None) -> None:
    """Raise unless each span that was paired has the text it was paired with."""
    for s in spans or ():
        if s["expect"] is not None and cut(s["start"], s["size"]) != s["expect"]:
            raise Differ
