"""Near-duplicate documents against brute force over all pairs."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from larkspur.llm import shingles, simhash  # noqa: E402

from .helpers import corpus, odd_tables, prose, table  # noqa: E402


def brute_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) <= 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_kept(rows):
    """The first row by (doc_id, null last) of each component."""
    sets, root = [brute_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(find(i), []).append(((r[0] is None, r[0] or 0), r[1]))
    return [min(x[0] for x in m) for m in out.values()]


def near_rows(seed):
    """Documents and copies with more and more changed words, from similarity 1 to about 0.4."""
    rng, rows = random.Random(seed), []
    for d in range(40):
        words = prose(rng, 300, 400).split(" ")
        rows.append((d * 20, " ".join(words), "en", "a", 1))
        for c in range(1, 15):
            copy = list(words)
            for i in range(c):
                copy[(i * 300 // c + 7 * d) % len(copy)] = f"changed{c}"
            rows.append((d * 20 + c, " ".join(copy), "en", "a", 1))
    return rows


@pytest.mark.parametrize("rows", [corpus(3), near_rows(4)], ids=["corpus", "near"])
def test_stage_keeps_one_of_each_group_down_to_the_limit(spark, rows):
    kept = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(brute_kept(rows))


def test_stage_on_odd_tables(spark):
    odd = odd_tables(spark)
    assert corpus_pipeline.near_duplicates(spark, odd["empty"], "").count() == 0
    assert corpus_pipeline.near_duplicates(spark, odd["extra"], "").columns == odd["extra"].columns


def test_rows_without_doc_id_are_separate_documents(spark):
    rng = random.Random(9)
    texts = [prose(rng, 120) for _ in range(6)]
    rows = [(None, t, "en", "a", 1) for t in texts[:4] + texts[:1]] + [(7, t, "en", "a", 1) for t in texts[3:5]]
    got = [r["text"] for r in simhash.one_of_each(table(spark, rows)).collect()]
    assert sorted(set(got) & set(texts[:3])) == sorted(texts[:3]) and len(got) == len(set(got))
    kept = corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()
    assert sorted(r["text"] for r in kept) == sorted(texts[:5])
    assert sorted(r["doc_id"] for r in kept if r["text"] in texts[3:5]) == [7, 7]
