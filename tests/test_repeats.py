"""Repeated ids, vectors of different lengths, bounded broadcasts."""

import numpy as np
import pyarrow as pa
import pytest

from larkspur.operators import kernels, routing
from larkspur.streaming.log import VectorLog


@pytest.mark.parametrize("router", [routing.CentroidRouter(np.eye(3)), routing.HashRouter(4, 3, 2, 3)], ids=["centroid", "hash"])
def test_repeated_ids_are_logged_once_each(spark, tmp_path, router):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    engine = VectorLog(spark, str(tmp_path), router)
    engine.append(df, 0)
    got = sorted((r["vec_id"], r["partition_id"], list(r["embedding"])) for r in engine.log().collect())
    want = []
    for i, v in rows:
        one = spark.createDataFrame([(i, v)], "vec_id long, embedding array<float>")
        want += [(i, r["partition_id"], v) for r in router.ingest(one).collect()]
    assert got == sorted(want)


def test_matrix_wants_one_length_and_no_nulls():
    assert kernels.matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1, 2], [3, 4]]
    assert kernels.matrix(pa.array([[9.0], [1.0, 2.0], [3.0, 4.0]])[1:]).tolist() == [[1, 2], [3, 4]]
    for bad in ([[1.0, 2.0, 3.0], [4.0]], [[1.0], None], [[1.0], [None]]):
        with pytest.raises(ValueError):
            kernels.matrix(pa.array(bad, pa.list_(pa.float64())))


def test_probe_table_bounds(spark):
    codes = spark.createDataFrame([(0, 5)], "qid long, code long")
    with pytest.raises(ValueError):
        routing.hash_probe_table(codes, 21, 6, 2)
    assert routing.hash_probe_table(codes, 3, 6, 2).count() == 2
