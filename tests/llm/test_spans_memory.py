"""What is held at a time in op2 is bounded, and its results are the same however small the parts are."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from larkspur.llm.anchors import Rows, Spec, contexts
from larkspur.llm.suffixes import WINDOW, byte_slices, byte_symbols, suffix_duplicates


def rows(groups, each, n):
    """Contexts of ``groups`` groups of ``each`` runs of n windows; the second half of a group repeats the first."""
    text = np.random.default_rng(1).integers(97, 101, (groups, each // 2, n + WINDOW - 1)).astype(np.uint8)
    data = np.concatenate([text, text], axis=1)
    k = groups * each
    sizes = np.full(k, n + WINDOW - 1)
    return Rows(np.repeat(np.arange(groups), each), np.arange(k), np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, n), np.full(k, n), np.cumsum(sizes) - sizes, data.ravel())


def test_suffixes_are_sorted_in_parts():
    some = rows(500, 20, 60)
    suffix_duplicates(rows(2, 4, 60))
    tracemalloc.start()
    doc, _, start, _ = suffix_duplicates(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(doc.tolist(), start.tolist(), strict=True)) == {(g * 20 + 10 + i, j) for g in range(500) for i in range(10) for j in range(60)}
    assert peak < 80e6


def test_contexts_of_a_batch_go_in_parts():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcd") for _ in range(168))
    item = {"h": 5, "at": (0 << 16) | (68 << 8) | 69, "hot": True}
    text = [passage if d % 2 else "".join(rng.choice("abcd") for _ in range(168)) for d in range(2000)]
    item_type = pa.struct([("h", pa.int64()), ("at", pa.int64()), ("hot", pa.bool_())])
    ask_type = pa.struct([(c, pa.int64()) for c in ("doc", "th", "at", "size", "from_at")])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(2000)), pa.array([0] * 2000), pa.array(text), pa.array([[item]] * 2000, pa.list_(item_type)), pa.array([[]] * 2000, pa.list_(ask_type))],
        ["doc", "th", "text", "items", "asks"],
    )
    out = list(contexts(byte_symbols, byte_slices, Spec(100, 32, True))(iter([batch])))
    assert len(out) > 1 and max(b.num_rows for b in out) < 60_000 and sum(b.num_rows for b in out) == 2000 * 69
    places = {(d, a >> 16) for b in out for d, a in zip(b.column("doc").to_pylist(), b.column("at").to_pylist(), strict=True)}
    assert places == {(d, j) for d in range(2000) for j in range(69)}
