"""Collections that come and go, segments indexed as files arrive, centroid files, places, times, pruned scans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import evaluate, routing
from larkspur.sources import records
from larkspur.streaming import log as vlog

from .test_vectors import brute, frame, got


def test_create_and_delete(spark, tmp_path):
    engine = vlog.VectorLog(spark, str(tmp_path / "c"), routing.CentroidRouter(np.eye(2)))
    engine.create()
    with pytest.raises(FileExistsError):
        engine.create()
    engine.append(frame(spark, np.eye(2)), 0)
    assert engine.log().count() == 2
    engine.delete()
    engine.delete()
    assert engine.log().count() == 0 and not (tmp_path / "c").exists()


def test_segments_are_indexed_as_they_arrive(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((30, 4)).astype(np.float32)
    engine = vlog.VectorLog(spark, str(tmp_path / "c"), routing.CentroidRouter(np.array([x[:20].mean(0), x[20:].mean(0)])))

    def put(partition, base, ids):
        folder = tmp_path / "in" / "topic" / f"partition_{partition}"
        folder.mkdir(parents=True, exist_ok=True)
        values = [records.encode_frame(np.array([i]), x[[i]]) for i in ids]
        (folder / f"{base}-{base + len(values)}.log").write_bytes(records.write_batch(base, values))

    def index():
        engine.index_files(str(tmp_path / "in"), str(tmp_path / "checkpoint")).awaitTermination()
        m = engine.manifest().select("partition_id", "segment_id", "base", "end", "n").collect()
        return sorted(tuple(r) for r in m)

    put(0, 0, range(10))
    (tmp_path / "in" / "topic" / "notes.txt").write_text("no segment")
    assert index() == [(0, 0, 0, 10, 10)]
    put(0, 10, range(10, 20))
    put(1, 5, range(20, 30))
    assert index() == [(0, 0, 0, 10, 10), (0, 10, 10, 20, 10), (1, 5, 5, 15, 10)]
    assert index() == [(0, 0, 0, 10, 10), (0, 10, 10, 20, 10), (1, 5, 5, 15, 10)]
    q = frame(spark, x[:3], names="qid long, qv array<double>")
    assert got(engine.index_search(q, 4, 2)) == brute(x, x[:3], 4)


def test_only_probed_partitions_are_read(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((200, 4))
    engine = vlog.VectorLog(spark, str(tmp_path / "c"), routing.CentroidRouter(x[:8]), segment_bytes=200)
    engine.append(frame(spark, x), 0)
    engine.index(0)
    q = frame(spark, x[:1], names="qid long, qv array<double>")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        for df in (engine.index_search(q, 3, 2), engine.log_search(q, 3, 2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"PartitionFilters: \[.*partition_id#\d+L? IN \(\d+,\d+\).*PushedFilters", plan)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_centroids_from_a_file_or_trained(spark, tmp_path):
    c = np.random.default_rng(2).standard_normal((3, 4))
    np.save(tmp_path / "c.npy", c)
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "label int, embedding array<double>").write.parquet(str(tmp_path / "c"))
    for path in (tmp_path / "c.npy", tmp_path / "c"):
        assert (routing.load_centroids(spark, str(path)) == c).all()
    e = frame(spark, c)
    assert routing.centroid_router(e, path=str(tmp_path / "c.npy")).n_partitions == 3
    assert routing.centroid_router(e, 2).n_partitions == 2
    np.save(tmp_path / "flat.npy", c[0])
    for bad in ({}, {"k": 2, "path": "x.npy"}, {"path": str(tmp_path / "flat.npy")}):
        with pytest.raises(ValueError):
            routing.centroid_router(e, **bad)


def test_places_are_bounded(spark):
    keys = spark.createDataFrame([(p, f"k{i}") for p in (1, 2) for i in range(5)], "p long, key string")
    rows = evaluate.placed_chunks(keys, "p", "key", 2, 6).collect()
    assert sorted((r["p"], r["place"]) for r in rows) == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 2), (2, 3), (2, 3), (2, 4), (2, 4), (2, 5)]
    with pytest.raises(ValueError):
        evaluate.placed_chunks(keys, "p", "key", 2, 5)
    assert evaluate.placed_chunks(keys.limit(0), "p", "key", 2, 0).count() == 0


def test_times_do_not_depend_on_the_time_zone(spark):
    from datetime import UTC, datetime

    times = [0.0, 1.5, 1.7e9, 1.7e9 + 0.123457, -1.25]
    df = spark.createDataFrame([(t,) for t in times], "t double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            rows = df.select("t", *evaluate.query_times(F.col("t"), F.col("t") + 0.25)).collect()
            assert [r["start_time"] for r in rows] == [datetime.fromtimestamp(r["t"], UTC).isoformat() for r in rows]
            assert {r["latency_seconds"] for r in rows} == {0.25}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_heads_follow_batches_and_replays(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((90, 4))
    engine = vlog.VectorLog(spark, str(tmp_path / "c"), routing.CentroidRouter(x[:3]))
    e = frame(spark, x)
    for batch, rows in ((0, e.where("vec_id < 30")), (2, e.limit(0)), (5, e.where("vec_id >= 30 AND vec_id < 60")), (6, e.where("vec_id >= 60")), (5, e.where("vec_id >= 30 AND vec_id < 60")), (6, e.where("vec_id >= 60"))):
        engine.append(rows, batch)
    rows = engine.log().select("partition_id", "log_offset").collect()
    for p in range(3):
        mine = sorted(r["log_offset"] for r in rows if r["partition_id"] == p)
        assert mine == list(range(len(mine)))
    assert len(rows) == 90
    assert {r["partition_id"]: r["head"] for r in engine._heads(7).collect()} == {r["partition_id"]: r["end_offset"] for r in vlog.end_offsets(engine.log()).collect()}


def test_committed_offsets_reach_the_scan(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal((200, 4))
    engine = vlog.VectorLog(spark, str(tmp_path / "c"), routing.CentroidRouter(x[:4]), segment_bytes=200)
    engine.append(frame(spark, x), 0)
    engine.index(0)
    rows = engine.open_rows(engine.manifest())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(log_offset" in plan
    whole = engine.log()
    want = vlog.tail(whole, vlog.start_offsets(whole, vlog.committed_offsets(engine.manifest())))
    key = lambda df: sorted((r["partition_id"], r["log_offset"]) for r in df.collect())
    assert key(rows) == key(want) and 0 < rows.count() < 200
