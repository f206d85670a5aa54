"""Long repeated passages by relative Lempel-Ziv parsing.

A word goes if it lies in a window of WINDOW words whose sequence also starts in a document with a
smaller doc_id. Candidate texts come in groups that share an anchor (see ``anchors``); the group's
windows are the indexed reference block. Each text is factored greedily: at a position that the index
knows from a smaller document, the factor runs as far as text and reference agree, found by binary
search over prefix hashes and verified word by word; it is a duplicate span. As a window across the end
of a factor may come from another reference, parsing goes on at the first window that the factor does
not hold whole, so no window is missed.

Words are compared by 64-bit hashes of their bytes, sequences of at least WINDOW of them word by word.

Defined cases: a null or blank text has no words; a null doc_id counts as larger than any and stays
null; rows of one doc_id do not remove from each other; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.anchors import Differ, Rows, Spec, U, covered, duplicate_spans, hashes, keyed, mix, prefix, verify
from larkspur.llm.common import texts, tune
from larkspur.llm.suffixes import byte_values

WINDOW = 50
GRAM = 20
PART = 1 << 20  #: bytes hashed at a time

_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True


def word_values(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PART)
        data = np.frombuffer(text, np.uint8, end - at, at)
        if end < len(text):  # cut behind the last blank, or take the long word whole
            blanks = np.flatnonzero(_blank[data])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                more = np.flatnonzero(_blank[np.frombuffer(text, np.uint8, len(text) - end, end)])
                end = end + int(more[0]) + 1 if len(more) else len(text)
            data = np.frombuffer(text, np.uint8, end - at, at)
        word = np.r_[False, ~_blank[data], False]
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edge[::2], edge[1::2]
        c = prefix(byte_values(text[at:end]))
        out.append(mix(hashes(c, start, stop - start) + (stop - start).astype(U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def word_slices(text: bytes | list[bytes]) -> Callable[[int, int], bytes]:
    words = text.split() if isinstance(text, bytes) else text
    return lambda start, size: b" ".join(words[start : start + size])


def parse(rows: Rows, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Duplicate spans (doc, th, start, length) of the contexts of whole groups, by greedy factors."""
    empty = (np.zeros(0, np.int64),) * 4
    data = rows.symbols
    c = prefix(mix(data + U(1)))
    row = np.repeat(np.arange(len(rows.n)), rows.n)
    first = np.cumsum(rows.n) - rows.n
    pos = rows.begin[row] + np.arange(len(row)) - first[row]
    name = hashes(c, pos, window)
    # the index: each window's occurrence in the smallest document of the group
    o = np.lexsort((rows.doc[row], name, rows.group[row]))
    new = np.r_[True, (name[o][1:] != name[o][:-1]) | (rows.group[row[o]][1:] != rows.group[row[o]][:-1])]
    source = np.empty(len(row), np.int64)
    source[o] = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    hit = rows.doc[row[source]] < rows.doc[row]
    # the next window, at or after each, that the index knows from a smaller document
    index = np.where(hit, np.arange(len(hit)), len(hit))
    after = np.minimum.accumulate(index[::-1])[::-1]
    after = np.r_[after, len(hit)]
    last = first + rows.n
    at = first.copy()
    live = np.arange(len(rows.n))
    found = []
    while len(live):
        at[live] = after[at[live]]
        live = live[at[live] < last[live]]
        if not len(live):
            break
        s, r = at[live], source[at[live]]
        # the factor goes on over as many windows as text and reference have and share
        low = np.ones(len(live), np.int64)
        high = np.minimum(last[live] - s, last[row[r]] - r)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = hashes(c, pos[s], mid + window - 1) == hashes(c, pos[r], mid + window - 1)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        size = low + window - 1
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (data[np.repeat(pos[s], size) + step] != data[np.repeat(pos[r], size) + step]).any():
            raise Differ
        found.append((rows.doc[live], rows.th[live], rows.start[live] + s - first[live], size))
        at[live] = s + low
        live = live[at[live] < last[live]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else empty


def passage_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, spans) of keyed documents: word spans found in documents with smaller doc_ids."""
    return duplicate_spans(docs, Spec(WINDOW, GRAM, False), word_values, word_values, word_slices, "<u8", parse)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, kept_hash, kept_text = [], [], [], []
        for text, spans in zip(texts(b), b.column("spans").to_pylist(), strict=True):
            words = text.split()
            verify(word_slices(words), spans)
            cut = covered(len(words), spans)
            kept = b" ".join([w for w, c in zip(words, cut.tolist(), strict=True) if not c] if spans else words)
            n.append(len(words))
            gone.append(int(cut.sum()))
            kept_hash.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode())
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_hash, pa.string()), pa.array(kept_text, pa.string())], names)


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of ``docs``."""
    tune(docs.sparkSession)
    base = keyed(docs)
    spans = passage_spans(base)
    return base.join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


REMOVE_PASSAGES_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 2}))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
r AS (SELECT doc_id, i FROM s JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
c AS (SELECT k.doc_id, k, x, coalesce(k - max(i) OVER (PARTITION BY k.doc_id ORDER BY k) < {WINDOW}, false) AS cut FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.i = k.k),
g AS (SELECT doc_id, count(*) FILTER (cut) AS n_removed, string_agg(x, ' ' ORDER BY k) FILTER (NOT cut) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
