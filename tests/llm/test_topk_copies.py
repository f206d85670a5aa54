"""Exact top-k on tables of many equal vectors: few rows are searched, none that could be among the best is left out."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from larkspur.llm import topk  # noqa: E402


@pytest.mark.parametrize("each_round", [4 << 20, 200])
def test_equal_vectors_are_searched_by_their_least_ids(spark, monkeypatch, each_round):
    monkeypatch.setattr(topk, "ROUND", each_round, raising=False)
    monkeypatch.setattr(topk, "QUERIES", 8)
    written = {}
    materialize = topk.materialize

    def noted(df, what, **more):
        out = materialize(df, what, **more)
        written.setdefault(what, []).append(out)
        return out

    monkeypatch.setattr(topk, "materialize", noted)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6, 4)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i % 6]]) for i in range(1500)] + [(0, [float(v) for v in x[0]])] * 9 + [(50, [float(v) for v in x[1]])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 3).collect())
    v = [[int(np.floor(256 * c)) for c in r] for _, r in rows]
    asked = {}
    for (i, _), e in sorted(zip(rows, v, strict=True), key=lambda r: (r[0][0], r[0][1])):
        if i % 50 == 0:
            asked.setdefault(i, e)
    want = []
    for q, e in asked.items():
        best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for (i, _), f in zip(rows, v, strict=True) if i != q)[:3]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    searched = written["topk-x"][0].selectExpr("sum(n)").first()[0]
    assert searched <= 6 * 4 + 9 + 2
