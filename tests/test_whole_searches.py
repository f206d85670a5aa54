"""Searches of all rows with vec_id % 50 = 0 against all rows, by brute force."""

import numpy as np
import pytest

from larkspur.operators import knn, routing
from larkspur.plans import catalogue
from larkspur.streaming import log as vlog

from .test_vectors import brute, frame, got

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id")
    return t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)


def brute_sets(ids, x, k=10, below=None):
    keep = np.ones(len(ids), bool) if below is None else ids < below
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        d = np.sqrt(((x[keep] - x[i]) ** 2).sum(1))
        out[int(ids[i])] = ids[keep][np.lexsort((ids[keep], d))[:k]].tolist()
    return out


def found_sets(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("name", ["exact_knn_l2", "topk_merge_partials", "mht_search_dedup"])
def test_every_fiftieth_vector_is_asked(spark, vectors, name):
    assert found_sets(catalogue.QUERIES[f"{name}_every50"](spark, SF)) == brute_sets(*vectors)


def test_the_last_epoch_holds_the_whole_table(spark, vectors):
    ids, x = vectors
    df = catalogue.QUERIES["epoch_knn_every50"](spark, SF).persist()
    for epoch, below in ((0, 400), (1, 800), (4, 2000)):
        assert found_sets(df.where(f"epoch = {epoch}")) == brute_sets(ids, x, below=below)


def test_searches_without_sql_cover_every_name():
    whole = {n.removesuffix("_every50") for n in catalogue.QUERIES if n.endswith("_every50")}
    assert len(whole) == 22 and whole <= set(catalogue.QUERIES) and not any(n.endswith("_every50") for n in catalogue.ORACLE_SQL)


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(knn, "MOST_QUERIES", 7)
    x = np.random.default_rng(3).standard_normal((40, 4))
    e, q = frame(spark, x), frame(spark, x, names="qid long, qv array<double>")
    assert got(knn.exact_knn(e, q, 3)) == brute(x, x, 3)
    router = routing.CentroidRouter(x[:4])
    rows = router.assign(e).drop("distance").join(e, "vec_id")
    assert got(vlog.probed_knn(rows, q, router.probe(q, 4), 3)) == brute(x, x, 3)


@pytest.mark.parametrize("name", ["ivf_search", "lsh_search", "hybrid_search", "index_ivfflat_search", "index_ivfpq_search", "index_hnsw_search", "stream_search"])
def test_recall_reaches_nine_tenths(spark, vectors, name):
    truth, found = brute_sets(*vectors), found_sets(catalogue.QUERIES[f"{name}_every50"](spark, SF))
    recall = np.mean([len(set(found.get(q, [])) & set(t)) / len(t) for q, t in truth.items()])
    print(f"recall {name} {recall:.4f}")
    assert recall >= 0.9
