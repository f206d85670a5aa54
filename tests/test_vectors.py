"""Expressions, kernels and routing against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import kernels, knn, routing


def frame(spark, x, ids=None, names="vec_id long, embedding array<double>"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], names)


def grid():
    return np.array([(i % 4, i // 4) for i in range(16)], float)


def brute(x, q, k, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    out = []
    for i, v in enumerate(q):
        best = sorted((math.dist(v, r), j) for r, j in zip(x, ids, strict=True))[:k]
        out += [(i, r, j, round(d, 9)) for r, (d, j) in enumerate(best, 1)]
    return out


def got(df):
    return sorted((r["qid"], r["rank"], r["vec_id"], round(r["distance"], 9)) for r in df.collect())


def test_ties_go_to_the_smaller_id(spark):
    x = grid()
    q = frame(spark, x[:5], names="qid long, qv array<double>")
    assert got(knn.exact_knn(frame(spark, x).repartition(3), q, 6)) == brute(x, x[:5], 6)


def test_k_beyond_candidates_and_empty_tables(spark):
    x = grid()[:3]
    q = frame(spark, x, names="qid long, qv array<double>")
    assert got(knn.exact_knn(frame(spark, x), q, 10)) == brute(x, x, 10)
    assert knn.exact_knn(frame(spark, x).where("vec_id < 0"), q, 3).count() == 0
    assert knn.exact_knn(frame(spark, x), q.where("qid < 0"), 3).count() == 0


def test_merge_is_associative_and_deduplicates(spark):
    x = np.random.default_rng(0).standard_normal((60, 4))
    q = frame(spark, x[:4], names="qid long, qv array<double>")
    v = frame(spark, x)
    parts = [knn.exact_knn(v.where(f"vec_id % 3 = {i}"), q, 5).drop("rank") for i in range(3)]
    flat = knn.merge_top_k(parts[0].union(parts[1]).union(parts[2]).union(parts[0]), 5)
    tree = knn.merge_top_k(knn.merge_top_k(parts[2].union(parts[1]), 5).drop("rank").union(parts[0]), 5)
    assert got(flat) == got(tree) == brute(x, x[:4], 5)


def test_cosine_rules(spark):
    x = np.array([[0.0, 0], [2, 0], [0, 3], [-1, 0]])
    rows = frame(spark, x).select("vec_id", V.cosine_distance(F.col("embedding"), V.literal([1.0, 0])).alias("d")).collect()
    assert {r["vec_id"]: round(r["d"], 9) for r in rows} == {0: 1.0, 1: 0.0, 2: 1.0, 3: 2.0}
    with pytest.raises(Exception, match="zero"):
        frame(spark, x).select(V.cosine_distance(F.col("embedding"), V.literal([0.0, 0]))).collect()
    with pytest.raises(ValueError):
        kernels.distances(np.zeros((1, 2)), x, "cosine")
    with pytest.raises(ValueError):
        knn.exact_knn(frame(spark, x), frame(spark, x, names="qid long, qv array<double>"), 1, "manhattan")


def test_expressions(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    b = F.array(F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(V.norm(a), V.l2(a, b), V.dot(a, a), V.normalize(a), V.normalize(b), V.hamming(F.lit(5), F.lit(6)), V.bucket_partition(F.lit(13), 4, 6), V.bucket_partition(F.lit(13), 4, 16)).first()
    assert list(r) == [5.0, 5.0, 25.0, [0.6, 0.8], [0.0, 0.0], 2, 1, 13]


def test_centroid_router(spark):
    x = grid()
    router = routing.CentroidRouter(x[[0, 3, 12, 15]])
    assigned = {r["vec_id"]: r["partition_id"] for r in router.assign(frame(spark, x)).collect()}
    c = router.centroids
    assert assigned == {i: min(range(4), key=lambda p: (round(math.dist(c[p], x[i]), 9), p)) for i in range(16)}
    q = frame(spark, x, names="qid long, qv array<double>")
    for n in (0, 1, 4, 9, -1):
        rows = router.probe(q, n).collect()
        assert len(rows) == 16 * max(0, min(n, 4))
        for r in rows:
            order = sorted(range(4), key=lambda p: (round(math.dist(c[p], x[r["qid"]]), 9), p))
            assert order[r["rank"] - 1] == r["partition_id"]
    with pytest.raises(ValueError):
        routing.CentroidRouter(np.zeros(3))


def brute_choice(router, codes, nprobe):
    n, bits, t = router.n_partitions, router.bits, router.tables
    want = max(0, min(n, nprobe))
    if not want:
        return []
    dist = []
    for c in codes:
        row = [bits + 1] * n
        for b in range(1 << bits):
            p = b if 1 << bits == n else b % n
            row[p] = min(row[p], (int(c) ^ b).bit_count())
        dist.append(row)
    order = [sorted(range(n), key=lambda p: (row[p], p)) for row in dist]
    share = (want + t - 1) // t
    chosen = set()
    for o in order:
        chosen.update(o[:share])
    at = [share] * t
    while len(chosen) < want:
        for k in range(t):
            while at[k] < n and order[k][at[k]] in chosen:
                at[k] += 1
            if at[k] < n and len(chosen) < want:
                chosen.add(order[k][at[k]])
                at[k] += 1
    return sorted((min(d[p] for d in dist), p) for p in chosen)[:want]


@pytest.mark.parametrize("partitions", [4, 6, 8, 16, 20])
@pytest.mark.parametrize("tables", [1, 3])
def test_hash_router_probes(partitions, tables):
    router = routing.HashRouter(partitions, 8, 4, tables)
    x = np.random.default_rng(1).standard_normal((30, 8))
    codes = router.code_matrix(x)
    for t in range(tables):
        assert codes[t].tolist() == [sum(1 << b for b in range(4) if v @ router.planes[t][:, b] >= 0) for v in x]
    for n in (0, 1, 3, partitions, partitions + 1):
        for c in codes.T:
            assert router.choose(c, n) == brute_choice(router, c, n)


def test_hash_router_rows(spark):
    x = np.random.default_rng(2).standard_normal((40, 8))
    router = routing.HashRouter(6, 8, 4, 3, metric="cosine")
    codes = router.code_matrix(x) % 6
    assert {(r["vec_id"], r["partition_id"]) for r in router.ingest(frame(spark, x)).collect()} == {(i, int(p)) for i in range(40) for p in codes[:, i]}
    assert {r["vec_id"]: r["partition_id"] for r in router.assign(frame(spark, x)).collect()} == dict(enumerate(codes[0].tolist()))
    single = routing.HashRouter(6, 8, 4)
    q = frame(spark, x, names="qid long, qv array<double>")
    table = routing.hash_probe_table(single.codes(q, "qid", "qv"), 4, 6, 3)
    key = lambda df: sorted((r["qid"], r["rank"], r["partition_id"], int(r["distance"])) for r in df.collect())
    assert key(table) == key(single.probe(q, 3))
    for bad in ({"bits": 0}, {"bits": 33}, {"bits": 4, "tables": 0}):
        with pytest.raises(ValueError):
            routing.HashRouter(**{"n_partitions": 6, "dimension": 8, **bad})


def test_kmeans(spark):
    x = np.vstack([np.random.default_rng(i).normal(10 * i, 0.1, (20, 3)) for i in range(3)])
    c = routing.train_centroids(frame(spark, x), 3)
    assert sorted(np.round(c.mean(1)).tolist()) == [0, 10, 20]
