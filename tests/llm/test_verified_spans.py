"""Equal hashes are not taken for equal texts, neither inside a batch nor between partitions."""

import numpy as np
import pytest

from larkspur.llm.anchors import Differ, Spec, aligned, duplicate_spans, keyed, verify
from larkspur.llm.suffixes import byte_slices, byte_symbols, byte_values, suffix_duplicates

SPEC = Spec(100, 32, True)


def blurred(text):
    """Values that take A for B, so that different texts have equal hashes."""
    return byte_values(text.replace(b"B", b"A"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def letters(seed, n=300):
    return "".join(np.random.default_rng(seed).choice(list("abcdefgh"), n))


def spans(spark, texts, parts, values):
    base = keyed(docs(spark, [(i, t) for i, t in enumerate(texts)])).repartition(parts, "doc_id")
    found = duplicate_spans(base, SPEC, values, byte_symbols, byte_slices, "u1", suffix_duplicates).collect()
    for r in found:
        verify(byte_slices(texts[r["doc"]].encode()), r["spans"])
    return {r["doc"]: sorted((s["start"], s["size"]) for s in r["spans"]) for r in found}


def test_equal_texts_pass(spark):
    texts = [letters(1), letters(2), letters(1), letters(1)]
    for parts in (1, 8):
        got = spans(spark, texts, parts, byte_values)
        assert set(got) == {2, 3}
        assert all(min(at for at, _ in v) == 0 and max(at + n for at, n in v) == 300 for v in got.values())


def test_a_collision_between_partitions_is_noticed(spark):
    a = letters(1)
    texts = [a[:150] + "A" + a[150:], *(letters(i) for i in range(2, 20)), a[:150] + "B" + a[150:]]
    with pytest.raises(Differ):
        spans(spark, texts, 8, blurred)


def test_a_collision_in_a_batch_is_noticed(spark):
    a = letters(1)
    with pytest.raises(Exception, match="two different strings have one hash"):
        spans(spark, [a[:150] + "A" + a[150:], a[:150] + "B" + a[150:]], 1, blurred)


def test_rows_that_repeat_are_one_document(spark):
    t = letters(5)
    base = keyed(docs(spark, [(7, t)] * 40 + [(9, t)] * 3))
    found = duplicate_spans(base, SPEC, byte_values, byte_symbols, byte_slices, "u1", suffix_duplicates).collect()
    assert {r["doc"] for r in found} == {9}


def test_aligned_pairs_are_joined():
    pair = (np.array([0, 0, 0, 1]), np.array([2, 2, 2, 2]))
    first, at, n = aligned(pair, np.array([10, 15, 40, 15]), np.array([0, 5, 31, 5]), np.array([8, 8, 8, 8]))
    got = sorted((int(pair[0][k]), int(a), int(m)) for k, a, m in zip(first, at, n, strict=True))
    assert got == [(0, 10, 13), (0, 40, 8), (1, 15, 8)]
