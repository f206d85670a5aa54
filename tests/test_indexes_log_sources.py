"""Index families, the log and its segments, streams and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import evaluate, index, knn, routing
from larkspur.sources import files, records
from larkspur.streaming import log as vlog

from .test_vectors import frame, got


def data(n=300, d=16, seed=0):
    return np.random.default_rng(seed).standard_normal((n, d))


# ---------------------------------------------------------------- indexes


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize(("family", "least"), [("flat", 1.0), ("ivfflat", 0.5), ("ivfpq", 0.3), ("hnsw", 0.9)])
def test_family_recall(family, least, metric):
    x = data()
    o = index.IndexOptions(family, metric, flat_up_to=32 if family != "flat" else 9999, lists=12, probes=6, pq_from=64, pq_bits=6, links=8)
    name, payload = index.build_payload(np.arange(300), x, o)
    assert name == family
    q = data(20, 16, 1)
    _, truth = index.build_payload(np.arange(300), x, index.IndexOptions("flat", metric, flat_up_to=9999))
    i, ids, d = index.search_payload(name, payload, q, 10, o)
    ti, tids, td = index.search_payload("flat", truth, q, 10, o)
    hits = [len(set(ids[i == r]) & set(tids[ti == r])) / 10 for r in range(20)]
    assert np.mean(hits) >= least
    assert all((np.diff(d[i == r]) >= 0).all() for r in range(20))
    again = index.build_payload(np.arange(300), x, o)[1]
    assert index.search_payload(name, again, q, 10, o)[1].tolist() == ids.tolist()


def test_family_choice():
    o = index.IndexOptions()
    assert [o.choose(n, 64) for n in (512, 513)] == ["flat", "ivfflat"]
    pq = index.IndexOptions("ivfpq")
    assert [pq.choose(999, 64), pq.choose(1000, 64), pq.choose(1000, 63), pq.choose(10, 64)] == ["ivfflat", "ivfpq", "ivfflat", "flat"]
    assert index.IndexOptions("unheard of").choose(600, 8) == "ivfflat"
    assert index.IndexOptions("hnsw").choose(600, 8) == "hnsw"


# ---------------------------------------------------------------- log


def small_log(spark, n=40, parts=4):
    x = data(n, 4)
    rows = frame(spark, x).withColumn("partition_id", F.col("vec_id") % parts)
    return x, vlog.append_offsets(rows)


def test_offsets_and_tails_at_every_cut(spark):
    x, log = small_log(spark)
    ends = {r["partition_id"]: r["end_offset"] for r in vlog.end_offsets(log).collect()}
    assert ends == dict.fromkeys(range(4), 10)
    for cut in (0, 3, 10):
        committed = spark.createDataFrame([(p, cut) for p in range(3)], "partition_id long, committed long")
        rest = vlog.tail(log, vlog.start_offsets(log, committed), vlog.end_offsets(log))
        assert rest.count() == 3 * (10 - cut) + 10


def test_index_and_tail_hold_every_row_once(spark):
    x, log = small_log(spark, 50)
    sealed = vlog.seal_rows(log, 4)
    manifest = vlog.segment_manifest(sealed)
    rest = vlog.tail(log, vlog.start_offsets(log, vlog.committed_offsets(manifest)))
    ids = [r["vec_id"] for r in sealed.select("vec_id").union(rest.select("vec_id")).collect()]
    assert sorted(ids) == list(range(50))
    assert all(r["end"] - r["base"] == r["n"] == 4 for r in manifest.collect())


def test_greedy_sealing(spark):
    rows = [(0, i, s) for i, s in enumerate([5, 5, 1, 9, 20, 3])] + [(1, i, 10) for i in range(3)]
    df = spark.createDataFrame(rows, "partition_id long, log_offset long, size long")
    out = sorted(tuple(r) for r in vlog.seal_bytes(df, 10, F.col("size")).collect())
    assert out == [(0, 0, 2, 10, True), (0, 2, 4, 10, True), (0, 4, 5, 20, True), (0, 5, 6, 3, False), (1, 0, 1, 10, True), (1, 1, 2, 10, True), (1, 2, 3, 10, False)]


@pytest.mark.parametrize("files_a_batch", [1, 3])
def test_stream_replay_gives_one_result(spark, tmp_path, files_a_batch):
    x = data(120, 8)
    frame(spark, x).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).repartitionByRange(3, "vec_id").write.parquet(f"{tmp_path}/in")
    engine = vlog.VectorLog(spark, str(tmp_path), routing.CentroidRouter(x[:5]), segment_bytes=400)
    q = frame(spark, x[:3], names="qid long, qv array<double>")
    assert engine.search(q, 3, 5).count() == 0

    def run():
        stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", files_a_batch).parquet(f"{tmp_path}/in")
        engine.ingest_stream(stream, f"{tmp_path}/checkpoint").awaitTermination()

    run()
    held = engine.log().count(), engine.manifest().count()
    assert held[0] == 120 and held[1] > 0
    run()  # a restart from the checkpoint adds nothing
    assert (engine.log().count(), engine.manifest().count()) == held
    exact = [(a, b, c) for a, b, c, _ in got(knn.exact_knn(frame(spark, x), q, 5))]
    assert [(a, b, c) for a, b, c, _ in got(engine.search(q, 5, 5))] == exact
    index_ids = {r["vec_id"] for r in engine.index_search(q, 200, 5).collect()}
    log_ids = {r["vec_id"] for r in engine.log_search(q, 200, 5).collect()}
    assert not index_ids & log_ids and index_ids | log_ids == set(range(120))


def test_recall_grows_with_probes(spark):
    x = data(200, 8)
    e, q = frame(spark, x), frame(spark, x[:10], names="qid long, qv array<double>")
    router = routing.CentroidRouter(x[:8])
    rows = router.assign(e).drop("distance").join(e, "vec_id")
    truth = knn.exact_knn(e, q, 5)
    seen = [evaluate.recall(vlog.probed_knn(rows, q, router.probe(q, n), 5), truth, 5).agg(F.avg("recall")).first()[0] for n in (1, 3, 8)]
    assert seen == sorted(seen) and seen[-1] == 1.0


# ---------------------------------------------------------------- sources


@pytest.mark.parametrize("kind", ["fbin", "npy"])
def test_vector_files(spark, tmp_path, kind):
    x = data(10, 8).astype(np.float32)
    path = f"{tmp_path}/x.{kind}"
    files.write_fbin(path, x) if kind == "fbin" else np.save(path, x)
    assert files.probe(path) == (10, 8)
    files.register(spark)
    rows = sorted(tuple(r) for r in spark.read.format(kind).option("split", "3").load(path).collect())
    assert [r[0] for r in rows] == list(range(10)) and np.allclose([r[1] for r in rows], x)
    some = spark.read.format(kind).option("start", "4").option("rows", "3").load(path)
    assert sorted(r["vec_id"] for r in some.collect()) == [4, 5, 6]
    cut = open(path, "rb").read()[:-5]
    open(path, "wb").write(cut)
    with pytest.raises(Exception, match="truncated"):
        spark.read.format(kind).load(path).collect()


def test_vector_folder(spark, tmp_path):
    x = data(50, 4).astype(np.float32)
    out = files.write_vectors(frame(spark, x), f"{tmp_path}/set", "fbin", parts=3)
    assert sum(r["rows"] for r in out.collect()) == 50
    files.register(spark)
    rows = sorted(tuple(r) for r in spark.read.format("fbin").option("split", "7").load(f"{tmp_path}/set").collect())
    assert [r[0] for r in rows] == list(range(50)) and np.allclose([r[1] for r in rows], x)


def test_frames():
    x = data(7, 4).astype(np.float32)
    ids, back = records.decode_frame(records.encode_frame(np.arange(7), x))
    assert ids.tolist() == list(range(7)) and (back == x).all()
    assert records.decode_frame(records.encode_frame(np.array(["5", "6"]), x[:2]))[0].tolist() == [5, 6]
    assert len(records.encode_frames(np.arange(7), x)) == 1 and records.frame_rows(10**7) == 1
    with pytest.raises(ValueError):
        records.encode_frame(np.arange(3), x)


def test_varints():
    for v in (0, 1, -1, 63, 64, -65, 2**31 - 1, -(2**31)):
        b = records.write_varint(v)
        assert records.read_varint(memoryview(b), 0) == (v, len(b))
    assert records.read_varint(memoryview(records.write_varint(-(2**62))), 0, 64)[0] == -(2**62)
    with pytest.raises(EOFError):
        records.read_varint(memoryview(b"\x80"), 0)
    with pytest.raises(ValueError):
        records.read_varint(memoryview(b"\x80" * 12), 0)


@pytest.mark.parametrize("codec", [0, 1, 4, 7])
def test_segments(spark, tmp_path, codec):
    x = data(6, 4).astype(np.float32)
    values = [records.encode_frame(np.arange(3), x[:3]), b'[9, 1.0, 2.0, 3.0, 4.0]', records.encode_frame(np.arange(3, 6), x[3:])]
    segment = records.write_batch(40, values[:2], codec) + records.write_batch(42, values[2:], codec)
    (tmp_path / "t" / "partition_3").mkdir(parents=True)
    (tmp_path / "t" / "partition_3" / "40-43.log").write_bytes(segment)
    (tmp_path / "t" / "partition_3" / "40.txt").write_bytes(b"no")
    got_rows = sorted((r["log_offset"], r["vec_id"]) for r in records.read_segments(spark, str(tmp_path)).collect())
    assert got_rows == [(40, 0), (40, 1), (40, 2), (41, 9), (42, 3), (42, 4), (42, 5)]


def test_bad_segments():
    good = records.write_batch(0, [records.encode_frame(np.arange(1), np.ones((1, 2)))])
    for bad in (good[:-3], good[:30], records.write_batch(0, [None])):
        with pytest.raises((EOFError, ValueError)):
            list(records.read_segment(bad))
    with pytest.raises(RuntimeError, match="lz4"):
        list(records.read_segment(records.write_batch(0, [b"[1, 2]"], 3)))


def test_segment_keys(spark):
    paths = {
        "t/partition_5/10-20.log": ("t", 5, 10, 20),
        "t/7/10-20.log": ("t", 7, 10, 20),
        "my-topic-4/10.log": ("my-topic", 4, 10, None),
        "9/x/partition_2/3/11.log": ("9", 2, 11, None),
        "9/10.log": (None, None, 10, None),
        "t/3/abc.log": ("t", 3, None, None),
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for r in df.select("path", *(c.alias(n) for c, n in zip(records.segment_key(F.col("path")), "tpbe", strict=True))).collect():
        want = paths[r["path"]]
        assert tuple(r)[2:] == want[1:] and (want[0] is None or r["t"] == want[0])


def test_placement_rules(spark):
    keys = spark.createDataFrame([(i % 3, f"k{i:02}") for i in range(20)], "g long, key string")
    rows = evaluate.chunks(keys, "g", "key", 4).collect()
    sizes = {}
    for r in rows:
        sizes[r["g"], r["chunk"]] = sizes.get((r["g"], r["chunk"]), 0) + 1
    assert max(sizes.values()) == 4 and len(rows) == 20
    placed = keys.where("g = 0").select("key", F.lit(3).alias("place"))
    places = {r["key"]: r["place"] for r in evaluate.cached_first(keys, placed, "key", 8).collect()}
    assert sum(p == 3 for p in places.values()) == 7 and all(-8 <= p < 0 or p == 3 for p in places.values())
    assert evaluate.cache_misses(keys, placed, "key").count() == 13


def test_results_file(spark, tmp_path):
    x = data(20, 4)
    q = frame(spark, x[:3], names="qid long, qv array<double>")
    evaluate.write_results(knn.exact_knn(frame(spark, x), q, 4), f"{tmp_path}/r", k=4, metric="euclidean")
    rows = spark.read.json(f"{tmp_path}/r").collect()
    assert len(rows) == 3 and all(len(r["results"]) == 4 and r["configuration"]["k"] == 4 for r in rows)
    assert all(r["results"][0]["id"] == str(r["query_index"]) and r["results"][0]["distance"] == 0 for r in rows)


def test_one_partition_write(spark, tmp_path):
    x = data(12, 4)
    engine = vlog.VectorLog(spark, str(tmp_path), routing.CentroidRouter(x[:3]), segment_bytes=60)
    engine.append_to(frame(spark, x), 0, 2)
    engine.index(0)
    assert {r["partition_id"] for r in engine.log().collect()} == {2}
    keys = engine.registry().collect()
    assert [r["partition"] for r in keys] == ["partition_2"] and len(keys[0]["keys"]) == engine.count_indexes().first()["indexes"] > 0
    with pytest.raises(ValueError):
        engine.append_to(frame(spark, x), 1, 3)
