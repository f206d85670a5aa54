"""Exact substring duplicates by a hash-compared suffix sort.

A byte goes if a WINDOW-byte string that covers it also starts earlier in the corpus. Candidate strings
come in groups (see ``anchors``); within a group the suffixes are merge-sorted. Two suffixes are
compared through prefix polynomial hashes: a binary search over lengths finds their common extension in
log2(WINDOW) steps, and the byte after it decides. Neighbours in the order whose common extension is a
whole window are verified byte by byte and make a class; all but its first string are duplicates.

Defined cases: a null text is empty; a null doc_id counts as larger than any and stays null; rows that
repeat doc_id and text are one document and get the same result each; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.anchors import Differ, Rows, Spec, U, covered, duplicate_spans, hashes, keyed, mix, prefix, repeated, verify
from larkspur.llm.common import texts, trimmed, tune

WINDOW = 100
GRAM = 32
AT_ONCE = 50_000  #: suffixes sorted at a time, those of one group apart

_table = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))


def byte_values(text: bytes) -> np.ndarray:
    return _table[np.frombuffer(text, np.uint8)]


def byte_symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def byte_slices(text: bytes) -> Callable[[int, int], bytes]:
    return lambda start, size: text[start : start + size]


class Comparer:
    """Order and equality of the suffixes of a buffer, each cut at ``width`` bytes."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width = data, width
        self.sums = prefix(_table[data])

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return hashes(self.sums, a, self.width) == hashes(self.sums, b, self.width)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        rest = np.flatnonzero(~self.equal(a, b))
        a, b = a[rest], b[rest]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width - 1, np.int64)
        while (low < high).any():  # longest common extension, below the width as they differ
            mid = (low + high + 1) >> 1
            same = hashes(self.sums, a, mid) == hashes(self.sums, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[rest] = self.data[a + low] < self.data[b + low]
        return out


def merge_sort(pos: np.ndarray, segment: np.ndarray, compare: Comparer) -> np.ndarray:
    """Stable order of suffixes within each segment (``segment`` is sorted): merges of all segments at once."""
    order = np.arange(len(pos))
    begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    size = np.diff(np.r_[begin, len(pos)])
    live = np.arange(len(begin))
    width = 1
    while True:
        live = live[size[live] > width]
        if not len(live):
            return order
        # every slot of the live segments, with the run it is in and the run it merges with
        n = size[live]
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = np.repeat(begin[live], n)
        limit = np.repeat(n, n)
        block = local // width
        left = block % 2 == 0
        other = np.where(left, (block + 1) * width, (block - 1) * width)
        low = np.minimum(other, limit)
        high = np.minimum(other + width, limit)
        at = low.copy()
        mine = pos[order[base + local]]
        busy = np.flatnonzero(at < high)
        while len(busy):
            mid = (at[busy] + high[busy]) >> 1
            theirs = pos[order[base[busy] + mid]]
            # a left element goes before equals of the right run, a right one after equals of the left
            is_left = left[busy]
            ahead = np.zeros(len(busy), bool)
            ahead[is_left] = compare.less(theirs[is_left], mine[busy][is_left])
            ahead[~is_left] = ~compare.less(mine[busy][~is_left], theirs[~is_left])
            at[busy] = np.where(ahead, mid + 1, at[busy])
            high[busy] = np.where(ahead, high[busy], mid)
            busy = busy[at[busy] < high[busy]]
        target = base + np.where(left, local, local - width) + (at - low)
        new = order.copy()
        new[target] = order[base + local]
        order = new
        width *= 2


def suffix_duplicates(rows: Rows, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Duplicate windows (doc, th, start, length) among the contexts of whole groups, in parts of about AT_ONCE suffixes."""
    cuts = np.flatnonzero(np.r_[True, rows.group[1:] != rows.group[:-1], True])
    upto = np.r_[0, np.cumsum(rows.n)][cuts]
    found, at = [], 0
    while at < len(cuts) - 1:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + AT_ONCE, side="right")) - 1)
        s, e = int(cuts[at]), int(cuts[end])
        first, last = int(rows.begin[s]), int(rows.begin[e]) if e < len(rows.begin) else len(rows.symbols)
        part = (x[s:e] for x in (rows.group, rows.doc, rows.th, rows.start, rows.anchor, rows.n))
        found.append(_duplicates(Rows(*part, rows.begin[s:e] - first, rows.symbols[first:last]), window))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _duplicates(rows: Rows, window: int) -> tuple[np.ndarray, ...]:
    empty = (np.zeros(0, np.int64),) * 4
    row = np.repeat(np.arange(len(rows.n)), rows.n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(rows.n) - rows.n, rows.n)
    # equal windows of a group have the anchor at the same place, so only those are sorted together
    segment = rows.group[row] * 256 + rows.anchor[row] - j
    doc, th, start, pos = rows.doc[row], rows.th[row], rows.start[row] + j, rows.begin[row] + j
    o = np.lexsort((start, th, doc, segment))
    segment, doc, th, start, pos = (x[o] for x in (segment, doc, th, start, pos))
    cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    keep = np.repeat(np.diff(np.r_[cuts, len(segment)]) > 1, np.diff(np.r_[cuts, len(segment)]))
    segment, doc, th, start, pos = (x[keep] for x in (segment, doc, th, start, pos))
    if not len(pos):
        return empty
    compare = Comparer(rows.symbols, window)
    o = merge_sort(pos, segment, compare)
    segment, doc, th, start, pos = (x[o] for x in (segment, doc, th, start, pos))
    same = np.flatnonzero((segment[1:] == segment[:-1]) & compare.equal(pos[1:], pos[:-1]))
    for at in range(0, len(same), 100_000):
        k = same[at : at + 100_000]
        span = np.arange(window)
        if (rows.symbols[pos[k + 1][:, None] + span] != rows.symbols[pos[k][:, None] + span]).any():
            raise Differ
    new = np.ones(len(pos), bool)
    new[same + 1] = False
    dup = repeated(doc, th, start, new, True)
    return doc[dup], th[dup], start[dup], np.full(int(dup.sum()), window)


def substring_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, spans) of keyed documents: byte spans that occur earlier."""
    return duplicate_spans(docs, Spec(WINDOW, GRAM, True), byte_values, byte_symbols, byte_slices, "u1", suffix_duplicates, F.octet_length)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, runs, kept_hash, kept_text = [], [], [], [], []
        for text, spans in zip(texts(b), b.column("spans").to_pylist(), strict=True):
            data = np.frombuffer(text, np.uint8)
            verify(byte_slices(text), spans)
            cut = covered(len(data), spans)
            kept = data[~cut].tobytes()
            n.append(len(data))
            gone.append(int(cut.sum()))
            runs.append(int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(len(cut) > 0 and cut[0]))
            kept_hash.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode(errors="ignore"))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept_hash, pa.string()), pa.array(kept_text, pa.string())], names)


def remove_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (broken characters at cuts left out)."""
    tune(docs.sparkSession)
    base = keyed(docs)
    spans = substring_spans(base)
    return base.join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans").mapInArrow(trimmed(_remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


REMOVE_SUBSTRINGS_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * WINDOW})) AS s FROM (
    SELECT doc_id, h, unnest(range(greatest(0, len(h) // 2 - {WINDOW - 1}))) AS i FROM d))),
b AS (SELECT doc_id, k, substr(h, 2 * k + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS k FROM d)),
c AS (SELECT b.doc_id, k, x, coalesce(k - max(w.i) OVER (PARTITION BY b.doc_id ORDER BY k) < {WINDOW}, false) AS cut
  FROM b LEFT JOIN (SELECT doc_id, i FROM w WHERE r > 1) w ON w.doc_id = b.doc_id AND w.i = b.k),
e AS (SELECT doc_id, k, x, cut, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY k), false) AS head FROM c),
g AS (SELECT doc_id, count(*) FILTER (cut) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(x, '' ORDER BY k) FILTER (NOT cut) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
