"""Named queries over the test tables and, where SQL can express them, their DuckDB SQL.

Each query reads whole tables; query vectors, probes and k are the queries' parameters. Distances are
rounded to six digits, as the last bits depend on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import evaluate, knn, routing
from larkspur.operators.index import IndexOptions, build_index, search_index
from larkspur.session import importable, workdir
from larkspur.sources import files, records
from larkspur.streaming import log as vlog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

K, LISTS, BITS = 10, 10, 4
EVERY = 50
PROBES, HASH_PROBES = 9, 5  #: of 10 centroids and of 6 hash partitions; recall of the searches is tested at 0.9
PLANES = routing.hyperplanes(64, BITS)
TABLES = routing.hyperplanes(64, BITS, 42, 3)
SCALED = "list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/embeddings.parquet")


def scaled(e: DataFrame) -> DataFrame:
    """Vectors of different lengths, so that cosine differs from Euclidean order."""
    return e.withColumn("embedding", F.transform(V.doubles(F.col("embedding")), lambda x: x * (1 + F.col("vec_id") % 7)))


def search(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """A query that asks all rows with vec_id % 50 = 0; its former second name ``name``_every50 stays, for the same query."""

    def add(f: Query) -> Query:
        QUERIES[f"{name}_every50"] = f
        return query(name, sql)(f)

    return add


def asked(e: DataFrame, every: int = EVERY) -> DataFrame:
    return e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def r6(c: Column | str, name: str = "distance") -> Column:
    """Rounded to six digits, without negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "vec_id", r6("distance"))


# ---------------------------------------------------------------- SQL pieces

D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
NORM = "sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
BASE = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 50 = 0)"
CENTROIDS = "c AS (SELECT label::BIGINT AS p, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"
ASSIGN = f"a AS (SELECT vec_id, p, d FROM (SELECT vec_id, p, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, p) AS r FROM (SELECT vec_id, p, {D2.format(a='v', b='c')} AS d FROM e, c)) WHERE r = 1)"
PROBE = f"pr AS (SELECT qid, p, d, row_number() OVER (PARTITION BY qid ORDER BY d, p) AS r FROM (SELECT qid, p, {D2.format(a='qv', b='c')} AS d FROM q, c))"


def top(source: str, k: int = K, distance: str = "sqrt(d)") -> str:
    """SQL of the k best of (qid, vec_id, d)."""
    return f"SELECT qid, rank::INT AS rank, vec_id, round({distance}, 6) + 0.0 AS distance FROM (SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM ({source})) WHERE rank <= {k}"


PAIRS = f"SELECT qid, vec_id, {D2.format(a='qv', b='v')} AS d FROM q, e"


# ---------------------------------------------------------------- exact search and expressions


@search("exact_knn_l2", f"WITH {BASE} {top(PAIRS)}")
def exact_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return ranked(knn.exact_knn(e, asked(e), K))


_COSINE = f"WITH e AS (SELECT vec_id, {SCALED} AS v FROM embeddings), q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 50 = 0) "
_COSINE += top(f"SELECT qid, vec_id, round(1 - {DOT.format(a='v', b='qv')} / ({NORM.format(a='v')} * {NORM.format(a='qv')}), 12) AS d FROM q, e", distance="d")


@search("exact_knn_cosine", _COSINE)
def exact_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(embeddings(spark, sf_dir))
    return ranked(knn.exact_knn(e, asked(e), K, "cosine"))


_IP = f"WITH e AS (SELECT vec_id, {SCALED} AS v FROM embeddings), q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 50 = 0) "
_IP += f"SELECT qid, rank::INT AS rank, vec_id, round(s, 6) + 0.0 AS score FROM (SELECT qid, vec_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS rank FROM (SELECT qid, vec_id, {DOT.format(a='v', b='qv')} AS s FROM q, e)) WHERE rank <= 10"


@search("exact_knn_ip", _IP)
def exact_knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(embeddings(spark, sf_dir))
    return knn.exact_knn(e, asked(e), K, "ip").select("qid", "rank", "vec_id", r6(-F.col("distance"), "score"))


@query("vector_norms", f"SELECT vec_id, round({NORM.format(a='v')}, 6) AS norm FROM (SELECT vec_id, {SCALED} AS v FROM embeddings)")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(embeddings(spark, sf_dir)).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("l2_normalize", f"SELECT vec_id, (i - 1)::INT AS i, round(v[i] / greatest({NORM.format(a='v')}, 1e-10), 6) + 0.0 AS x FROM (SELECT vec_id, {SCALED} AS v FROM embeddings), range(1, 65) t(i)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(embeddings(spark, sf_dir))
    return e.select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", r6("x", "x"))


@search("l2_expression", f"WITH {BASE} SELECT qid, vec_id, round(sqrt({D2.format(a='qv', b='v')}), 6) + 0.0 AS distance FROM q, e")
def l2_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    q = asked(e.withColumnRenamed("v", "embedding"))
    return e.crossJoin(q).select("qid", "vec_id", r6(V.l2(F.col("v"), F.col("qv"))))


# ---------------------------------------------------------------- centroid routing


def centroids(e: DataFrame) -> np.ndarray:
    return routing.as_matrix(routing.label_centroids(e))


@query("ivf_centroids", "SELECT label, (i - 1)::INT AS i, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def ivf_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.label_centroids(embeddings(spark, sf_dir)).select("label", "i", r6("m", "m"))


@query("ivf_assign_l2", f"WITH {BASE}, {CENTROIDS}, {ASSIGN} SELECT vec_id, p AS partition_id, round(sqrt(d), 6) AS distance FROM a")
def ivf_assign_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return routing.CentroidRouter(centroids(e)).assign(e).select("vec_id", "partition_id", r6("distance"))


_ASSIGN_COS = f"WITH {BASE}, {CENTROIDS} SELECT vec_id, p AS partition_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, p, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, p) AS r FROM (SELECT vec_id, p, 1 - {DOT.format(a='v', b='c')} / ({NORM.format(a='v')} * {NORM.format(a='c')}) AS d FROM e, c)) WHERE r = 1"


@query("ivf_assign_cosine", _ASSIGN_COS)
def ivf_assign_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return routing.CentroidRouter(centroids(e), "cosine").assign(e).select("vec_id", "partition_id", r6("distance"))


@query("ivf_partition_sizes", f"WITH {BASE}, {CENTROIDS}, {ASSIGN} SELECT p AS partition_id, count(*) AS n FROM a GROUP BY p")
def ivf_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return routing.CentroidRouter(centroids(e)).assign(e).groupBy("partition_id").agg(F.count("*").alias("n"))


def _probe_sql(n: int) -> str:
    return f"WITH {BASE}, {CENTROIDS}, {PROBE} SELECT qid, r::INT AS rank, p AS partition_id, round(sqrt(d), 6) AS distance FROM pr WHERE r <= {n}"


def _probe(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return routing.CentroidRouter(centroids(e)).probe(asked(e), n).select("qid", "rank", "partition_id", r6("distance"))


@search("ivf_probe", _probe_sql(3))
def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir, 3)


@search("ivf_probe_all", _probe_sql(10))
def ivf_probe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir, 99)


def _ivf(e: DataFrame, *nprobes: int) -> list[DataFrame]:
    """Search results at each nprobe; centroids are trained once and queries probed once."""
    router = routing.CentroidRouter(centroids(e))
    rows = router.ingest(e, carry=True)
    probes = router.probe(asked(e), max(nprobes))
    return [vlog.probed_knn(rows, asked(e), probes.where(F.col("rank") <= p), K) for p in nprobes]


_IVF_PAIRS = f"SELECT qid, e.vec_id, {D2.format(a='qv', b='v')} AS d FROM pr JOIN a USING (p) JOIN e ON e.vec_id = a.vec_id JOIN q USING (qid) WHERE pr.r <= {{n}}"


@search("ivf_search", f"WITH {BASE}, {CENTROIDS}, {ASSIGN}, {PROBE} {top(_IVF_PAIRS.format(n=PROBES))}")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_ivf(embeddings(spark, sf_dir), PROBES)[0])


def _recall_sql(n: int) -> str:
    return f"SELECT {n}::INT AS nprobe, qid, (SELECT count(*) FROM ({top(_IVF_PAIRS.format(n=n))}) f WHERE f.qid = t.qid AND f.vec_id IN (SELECT vec_id FROM truth u WHERE u.qid = t.qid)) / 10.0 AS recall FROM (SELECT DISTINCT qid FROM truth) t"


_RECALL = f"WITH {BASE}, {CENTROIDS}, {ASSIGN}, {PROBE}, truth AS ({top(PAIRS)}) "


@search("ivf_recall_at_k", f"{_RECALL} SELECT qid, recall::DOUBLE AS recall FROM ({_recall_sql(PROBES)})")
def ivf_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return evaluate.recall(_ivf(e, PROBES)[0], knn.exact_knn(e, asked(e), K), K)


@search("ivf_recall_by_nprobe", f"{_RECALL} SELECT nprobe, round(avg(recall), 6)::DOUBLE AS recall FROM ({' UNION ALL '.join(_recall_sql(n) for n in (1, 2, 4, 10))}) GROUP BY nprobe")
def ivf_recall_by_nprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    tried = (1, 2, 4, 10)
    found = [f.withColumn("nprobe", F.lit(n)) for n, f in zip(tried, _ivf(e, *tried), strict=True)]
    both = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    truth = knn.exact_knn(e, asked(e), K).select("qid", "vec_id", F.lit(1).alias("hit"))
    hits = both.join(truth, ["qid", "vec_id"], "left").groupBy("nprobe").agg(F.count("hit").alias("hits"))
    return hits.select("nprobe", F.round(F.col("hits") / (F.lit(float(K)) * truth.select("qid").distinct().count()), 6).alias("recall"))


# ---------------------------------------------------------------- hash routing


def _planes_sql(planes: np.ndarray) -> str:
    return ", ".join(f"({b}, [{', '.join(repr(float(x)) for x in planes[:, b])}]::DOUBLE[])" for b in range(planes.shape[1]))


def _codes_sql(planes: np.ndarray, vector: str = "embedding::DOUBLE[]") -> str:
    return f"SELECT vec_id, sum(CASE WHEN {DOT.format(a='v', b='h')} >= 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS code FROM (SELECT vec_id, {vector} AS v FROM embeddings), (VALUES {_planes_sql(planes)}) p(b, h) GROUP BY vec_id"


CODES = f"codes AS ({_codes_sql(PLANES)})"


def _codes(spark: SparkSession, sf_dir: str, metric: str = "euclidean", scale: bool = False) -> DataFrame:
    e = embeddings(spark, sf_dir)
    router = routing.HashRouter(16, 64, BITS, planes=PLANES[None], metric=metric)
    return router.codes(scaled(e) if scale else e).select("vec_id", "code")


@query("lsh_codes", _codes_sql(PLANES))
def lsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", V.hash_code(V.doubles(F.col("embedding")), PLANES.tolist()).alias("code"))


@query("lsh_codes_cosine", _codes_sql(PLANES, f"list_transform({SCALED}, lambda x: x / 1.0)"))
def lsh_codes_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir, "cosine", True)


@query("lsh_assign_mod", f"WITH {CODES} SELECT vec_id, code % 6 AS partition_id FROM codes")
def lsh_assign_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.HashRouter(6, 64, BITS, planes=PLANES[None]).assign(embeddings(spark, sf_dir))


@query("lsh_assign_bijective", f"WITH {CODES} SELECT vec_id, code AS partition_id FROM codes")
def lsh_assign_bijective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.HashRouter(16, 64, BITS, planes=PLANES[None]).assign(embeddings(spark, sf_dir))


@search("lsh_hamming", f"WITH {CODES} SELECT q.vec_id AS qid, x.vec_id, bit_count(xor(q.code, x.code))::BIGINT AS distance FROM codes q, codes x WHERE q.vec_id % 50 = 0")
def lsh_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _codes(spark, sf_dir)
    q = asked(c.withColumnRenamed("code", "embedding")).withColumnRenamed("qv", "qcode")
    return c.crossJoin(q).select("qid", "vec_id", V.hamming(F.col("code"), F.col("qcode")).alias("distance"))


def _lsh_probe_sql(partitions: int, n: int) -> str:
    inner = f"SELECT vec_id AS qid, p AS partition_id, coalesce(min(bit_count(xor(code, b))), {BITS + 1})::BIGINT AS distance FROM codes CROSS JOIN range({partitions}) t(p) LEFT JOIN range({1 << BITS}) u(b) ON {'b' if partitions == 1 << BITS else f'b % {partitions}'} = p WHERE vec_id % 50 = 0 GROUP BY vec_id, p"
    return f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, partition_id)::INT AS rank, partition_id, distance FROM ({inner}) QUALIFY rank <= {n}"


@search("lsh_probe", f"WITH {CODES} {_lsh_probe_sql(20, 20)}")
def lsh_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(_codes(spark, sf_dir).withColumnRenamed("code", "embedding")).withColumnRenamed("qv", "code")
    return routing.hash_probe_table(q, BITS, 20, 20)


_LSH_PAIRS = f"SELECT qid, e.vec_id, {D2.format(a='qv', b='v')} AS d FROM lp JOIN codes x ON x.code % 6 = lp.partition_id JOIN e ON e.vec_id = x.vec_id JOIN q USING (qid)"


@search("lsh_search", f"WITH {BASE}, {CODES}, lp AS ({_lsh_probe_sql(6, HASH_PROBES)}) {top(_LSH_PAIRS)}")
def lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    router = routing.HashRouter(6, 64, BITS, planes=PLANES[None])
    rows = router.assign(e, carry=True)
    return ranked(vlog.probed_knn(rows, asked(e), router.probe(asked(e), HASH_PROBES), K))


_MHT = " UNION ALL ".join(f"SELECT vec_id, {t}::INT AS \"table\", code FROM ({_codes_sql(TABLES[t])})" for t in range(3))


@query("mht_codes", _MHT)
def mht_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.HashRouter(6, 64, BITS, 3).codes(embeddings(spark, sf_dir))


@query("mht_ingest_replicas", f"SELECT DISTINCT vec_id, code % 6 AS partition_id FROM ({_MHT})")
def mht_ingest_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.HashRouter(6, 64, BITS, 3).ingest(embeddings(spark, sf_dir))


@search("mht_search_dedup", f"WITH {BASE} {top(PAIRS)}")
def mht_search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partitions are probed, so replicas meet and the result is that of exact search."""
    e = embeddings(spark, sf_dir)
    router = routing.HashRouter(6, 64, BITS, 3)
    rows = router.ingest(e, carry=True)
    return ranked(vlog.probed_knn(rows, asked(e), router.probe(asked(e), 6), K))


@query("mht_probe")
def mht_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return routing.HashRouter(20, 64, BITS, 3).probe(asked(e, 1), 5)


_MHT_ALL = f"SELECT vec_id AS qid, bucket % 6 AS p, min(bit_count(xor(code, bucket))) AS d FROM ({_MHT}), (SELECT range AS bucket FROM range({1 << BITS})) GROUP BY vec_id, bucket % 6"


@query("mht_probe_all", f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, p)::INT AS rank, p AS partition_id, d::DOUBLE AS distance FROM ({_MHT_ALL})")
def mht_probe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partitions by their least distance over three tables."""
    e = embeddings(spark, sf_dir)
    return routing.HashRouter(6, 64, BITS, 3).probe(asked(e, 1), 6)


@query("repeated_ids_append", f"WITH {BASE}, {CENTROIDS}, {ASSIGN} SELECT vec_id, p AS partition_id, (row_number() OVER (PARTITION BY p, vec_id ORDER BY d))::BIGINT AS copy FROM (SELECT a.*, unnest([1, 2]) FROM a)")
def repeated_ids_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an id are logged as often as they come."""
    e = embeddings(spark, sf_dir)
    engine = vlog.VectorLog(spark, workdir(spark, "repeats"), routing.CentroidRouter(centroids(e)))
    engine.append(e.union(e), 0)
    order = Window.partitionBy("partition_id", "vec_id").orderBy("log_offset")
    return engine.log().select("vec_id", "partition_id", F.row_number().over(order).cast("long").alias("copy"))


# ---------------------------------------------------------------- log, segments, both tiers


def placed(e: DataFrame) -> DataFrame:
    """Every vector in the partition of its label, as a log in order of vec_id."""
    return vlog.append_offsets(e.select(F.col("label").cast("long").alias("partition_id"), "vec_id", "embedding"))


LOG = "lg AS (SELECT label::BIGINT AS partition_id, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS log_offset FROM embeddings)"
SEALED = "sg AS (SELECT *, log_offset // 20 AS s FROM lg), sealed AS (SELECT partition_id, min(log_offset) AS segment_id, min(log_offset) AS base, max(log_offset) + 1 AS \"end\", count(*) AS n FROM sg GROUP BY partition_id, s HAVING count(*) = 20)"
TAIL = "tl AS (SELECT lg.* FROM lg LEFT JOIN (SELECT partition_id, max(\"end\") AS c FROM sealed GROUP BY partition_id) USING (partition_id) WHERE log_offset >= coalesce(c, 0))"


@query("log_append_offsets", f"WITH {LOG} SELECT partition_id, vec_id, log_offset FROM lg")
def log_append_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(embeddings(spark, sf_dir)).select("partition_id", "vec_id", "log_offset")


@query("log_end_offsets", f"WITH {LOG} SELECT partition_id, max(log_offset) + 1 AS end_offset FROM lg GROUP BY partition_id")
def log_end_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vlog.end_offsets(placed(embeddings(spark, sf_dir)))


def _committed(log: DataFrame) -> DataFrame:
    """Partitions below 7 have committed half of their rows."""
    return vlog.end_offsets(log).where("partition_id < 7").select("partition_id", F.floor(F.col("end_offset") / 2).cast("long").alias("committed"))


STARTS = "st AS (SELECT partition_id, CASE WHEN partition_id < 7 THEN (max(log_offset) + 1) // 2 ELSE 0 END AS start_offset FROM lg GROUP BY partition_id)"


@query("log_start_offsets", f"WITH {LOG}, {STARTS} SELECT partition_id, start_offset::BIGINT AS start_offset FROM st")
def log_start_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = placed(embeddings(spark, sf_dir))
    return vlog.start_offsets(log, _committed(log))


@query("tail_scan", f"WITH {LOG}, {STARTS} SELECT partition_id, log_offset, vec_id FROM lg JOIN st USING (partition_id) WHERE log_offset >= start_offset")
def tail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = placed(embeddings(spark, sf_dir))
    return vlog.tail(log, vlog.start_offsets(log, _committed(log)), vlog.end_offsets(log)).select("partition_id", "log_offset", "vec_id")


@query("seal_segments", f"WITH {LOG}, {SEALED} SELECT partition_id, segment_id, log_offset, vec_id FROM lg JOIN sealed USING (partition_id) WHERE log_offset >= base AND log_offset < \"end\"")
def seal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vlog.seal_rows(placed(embeddings(spark, sf_dir)), 20).select("partition_id", "segment_id", "log_offset", "vec_id")


@query("segment_manifest", f"WITH {LOG}, {SEALED} SELECT partition_id, segment_id, base, \"end\", n FROM sealed")
def segment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vlog.segment_manifest(vlog.seal_rows(placed(embeddings(spark, sf_dir)), 20))


@query("unsealed_tail", f"WITH {LOG}, {SEALED}, {TAIL} SELECT partition_id, log_offset, vec_id FROM tl")
def unsealed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = placed(embeddings(spark, sf_dir))
    manifest = vlog.segment_manifest(vlog.seal_rows(log, 20))
    return vlog.tail(log, vlog.start_offsets(log, vlog.committed_offsets(manifest))).select("partition_id", "log_offset", "vec_id")


@query("index_counts", f"WITH {LOG}, {SEALED} SELECT partition_id, count(*) AS indexes FROM sealed GROUP BY partition_id")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = vlog.segment_manifest(vlog.seal_rows(placed(embeddings(spark, sf_dir)), 20))
    return manifest.groupBy("partition_id").agg(F.count("*").alias("indexes"))


@query("seal_segments_bytes", f"WITH {LOG} SELECT partition_id, min(log_offset) AS base, max(log_offset) + 1 AS \"end\", 264 * count(*) AS bytes, count(*) = 18 AND max(log_offset) < max(top) AS sealed FROM (SELECT partition_id, log_offset, max(log_offset) OVER (PARTITION BY partition_id) AS top FROM lg) GROUP BY partition_id, log_offset // 18")
def seal_segments_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 264 bytes, segments of at most 5,000: 18 rows each."""
    return vlog.seal_bytes(placed(embeddings(spark, sf_dir)), 5_000)


def _index(e: DataFrame, options: IndexOptions, rows: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A log by label, its index of sealed segments, and the tail."""
    log = placed(e)
    sealed = vlog.seal_rows(log, rows)
    manifest = vlog.segment_manifest(sealed)
    return build_index(sealed, options), vlog.tail(log, vlog.start_offsets(log, vlog.committed_offsets(manifest))), log


_HYBRID = f"SELECT qid, lg.vec_id, {D2.format(a='qv', b='v')} AS d FROM pr JOIN lg ON lg.partition_id = pr.p JOIN q USING (qid) WHERE pr.r <= {PROBES}"


@search("hybrid_search", f"WITH {BASE}, {CENTROIDS}, {PROBE}, {LOG} {top(_HYBRID)}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat indexes of the sealed segments and a scan of the tail, merged."""
    e = embeddings(spark, sf_dir)
    index, rest, _ = _index(e, IndexOptions())
    probes = routing.CentroidRouter(centroids(e)).probe(asked(e), PROBES)
    both = search_index(index, asked(e), probes, K, IndexOptions()).unionByName(vlog.probed_knn(rest, asked(e), probes, K))
    return ranked(knn.merge_top_k(both.drop("rank"), K))


@search("topk_merge_partials", f"WITH {BASE} {top(PAIRS)}")
def topk_merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top k of each label, merged in two levels."""
    e = embeddings(spark, sf_dir)
    parts = [knn.exact_knn(e.where(f"label % 3 = {i}"), asked(e), K).drop("rank") for i in range(3)]
    left = knn.merge_top_k(parts[0].unionByName(parts[1]), K).drop("rank")
    return ranked(knn.merge_top_k(left.unionByName(parts[2]), K))


EPOCHS = (0, 1, 4)  #: of five, each a fifth of the ids; the last ends with the greatest id
_SIZE = "(SELECT (max(vec_id) + 5) // 5 FROM embeddings)"
_EPOCH = " UNION ALL ".join(f"SELECT {k}::INT AS epoch, * FROM ({top(PAIRS + f' WHERE vec_id < {k + 1} * {_SIZE}')})" for k in EPOCHS)


def _epochs(e: DataFrame) -> tuple[tuple[int, int], ...]:
    """(epoch, ids an epoch)."""
    size = -(-((e.agg(F.max("vec_id")).first()[0] or 0) + 1) // 5)
    return tuple((k, size) for k in EPOCHS)


@search("epoch_knn", f"WITH {BASE} {_EPOCH}")
def epoch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    parts = [ranked(knn.exact_knn(evaluate.epoch_rows(e, k, n), asked(e), K)).select(F.lit(k).alias("epoch"), "*") for k, n in _epochs(e)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EPOCH_RECALL = " UNION ALL ".join(f"SELECT {k}::INT AS epoch, (SELECT count(*) FROM (SELECT qid, vec_id FROM ep WHERE epoch = {k}) JOIN (SELECT qid, vec_id FROM ep WHERE epoch = 4) USING (qid, vec_id)) / (SELECT count(*)::DOUBLE FROM ep WHERE epoch = 4) AS recall" for k in EPOCHS)


@search("epoch_recall", f"WITH {BASE}, ep AS ({_EPOCH}) SELECT epoch, round(recall::DOUBLE, 6) AS recall FROM ({_EPOCH_RECALL})")
def epoch_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last epoch's neighbours, the share that earlier epochs had found."""
    e = embeddings(spark, sf_dir)
    epochs = _epochs(e)
    truth = knn.exact_knn(evaluate.epoch_rows(e, *epochs[-1]), asked(e), K)
    parts = [evaluate.recall(knn.exact_knn(evaluate.epoch_rows(e, k, n), asked(e), K), truth, K).agg(F.lit(k).alias("epoch"), F.round(F.avg("recall"), 6).alias("recall")) for k, n in epochs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- service rules


def _keys(e: DataFrame) -> DataFrame:
    m = vlog.segment_manifest(vlog.seal_rows(placed(e), 20))
    return m.select("partition_id", F.concat_ws("/", F.lit("idx"), F.concat(F.lit("partition_"), "partition_id"), F.concat(F.lit("index_"), "base", F.lit(".ann"))).alias("key"))


KEYS = f"{LOG}, {SEALED}, ks AS (SELECT partition_id, 'idx/partition_' || partition_id || '/index_' || base || '.ann' AS key FROM sealed)"


@query("cache_misses", f"WITH {KEYS} SELECT partition_id, key FROM ks WHERE partition_id % 3 <> 0")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(embeddings(spark, sf_dir))
    return evaluate.cache_misses(keys, keys.where("partition_id % 3 = 0"), "key").select("partition_id", "key")


@query("cache_hits", f"WITH {KEYS} SELECT partition_id, key FROM ks WHERE partition_id % 3 = 0")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(embeddings(spark, sf_dir))
    return keys.join(keys.where("partition_id % 3 = 0").select("key"), "key", "left_semi").select("partition_id", "key")


@query("l1_chunks", f"WITH {KEYS} SELECT partition_id, key, (row_number() OVER (PARTITION BY partition_id ORDER BY key) - 1) // 2 AS chunk FROM ks")
def l1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.chunks(_keys(embeddings(spark, sf_dir)), "partition_id", "key", 2)


@query("l2_hash_route")
def l2_hash_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(embeddings(spark, sf_dir)).select("key", evaluate.hash_route(F.col("key"), 16).alias("place"))


@query("registry_keys", f"WITH {KEYS} SELECT split(key, '/')[-2] AS partition, count(*) AS n FROM ks GROUP BY 1")
def registry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(embeddings(spark, sf_dir)).groupBy(F.element_at(F.split("key", "/"), -2).alias("partition")).agg(F.count("*").alias("n"))


@query("registry_lists", f"WITH {KEYS} SELECT 'partition_' || partition_id AS partition, string_agg(key, ' ' ORDER BY key) AS keys FROM ks GROUP BY 1")
def registry_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = vlog.segment_manifest(vlog.seal_rows(placed(embeddings(spark, sf_dir)), 20))
    return vlog.registry(m).select("partition", F.array_join("keys", " ").alias("keys"))


@query("registry_merge", f"WITH {LOG}, {SEALED} SELECT partition_id, segment_id, base, \"end\", n FROM sealed")
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are registered again stay as they are."""
    m = vlog.segment_manifest(vlog.seal_rows(placed(embeddings(spark, sf_dir)), 20))
    return vlog.registered(m.where("partition_id < 6"), m.where("partition_id > 3").withColumn("n", F.when(F.col("partition_id") < 6, -1).otherwise(F.col("n"))))


_RESULTS = f"SELECT qid AS query_index, string_agg(vec_id || ':' || rank, ' ' ORDER BY rank) AS results FROM ({top(PAIRS)}) GROUP BY qid"


@search("query_results", f"WITH {BASE} {_RESULTS}")
def query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    r = evaluate.query_results(knn.exact_knn(e, asked(e), K))
    return r.select("query_index", F.array_join(F.transform("results", lambda x, i: F.concat(x["id"], F.lit(":"), i + 1)), " ").alias("results"))


_PATHS = "SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'topic/partition_' || label || '/' || vec_id || '-' || (vec_id + 20) || '.log' WHEN 1 THEN 'topic/' || label || '/' || vec_id || '-' || (vec_id + 20) || '.log' WHEN 2 THEN 'topic-' || label || '/' || vec_id || '.log' ELSE '7/x/partition_' || label || '/3/' || vec_id || '.log' END AS path, label FROM embeddings"


@query("segment_key_parse", f"SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN '7' ELSE 'topic' END AS topic, label::BIGINT AS partition_id, vec_id AS base, CASE WHEN vec_id % 4 < 2 THEN vec_id + 20 END AS \"end\" FROM ({_PATHS})")
def segment_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("vec_id"), F.col("label")
    span = F.concat(i, F.lit("-"), i + 20, F.lit(".log"))
    path = F.when(i % 4 == 0, F.concat(F.lit("topic/partition_"), p, F.lit("/"), span)).when(i % 4 == 1, F.concat(F.lit("topic/"), p, F.lit("/"), span)).when(i % 4 == 2, F.concat(F.lit("topic-"), p, F.lit("/"), i, F.lit(".log"))).otherwise(F.concat(F.lit("7/x/partition_"), p, F.lit("/3/"), i, F.lit(".log")))
    topic, partition, base, end = records.segment_key(path)
    return embeddings(spark, sf_dir).select("vec_id", topic.alias("topic"), partition.alias("partition_id"), base.alias("base"), end.alias("end"))


@query("latency_stats", "SELECT count(value) AS n, count(*) FILTER (value IS NULL) AS failed, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.latency_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value"))
    return s.select("n", "failed", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")))


_START, _END = "(1.7e9::DOUBLE + event_id / 4::DOUBLE)", "(1.7e9::DOUBLE + event_id / 4::DOUBLE + value / 1000)"
_ISO = "replace(strftime(make_timestamp(round({} * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '+00:00'"


@query("query_times", f"SELECT event_id, {_ISO.format(_START)} AS start_time, {_ISO.format(_END)} AS end_time, round({_END} - {_START}, 6) AS latency_seconds FROM events")
def query_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit(1.7e9) + F.col("event_id") / F.lit(4.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *evaluate.query_times(start, start + F.col("value") / 1000))


@query("l1_places", f"WITH {KEYS}, ch AS (SELECT partition_id, key, (row_number() OVER (PARTITION BY partition_id ORDER BY key) - 1) // 2 AS chunk FROM ks) SELECT partition_id, key, (dense_rank() OVER (ORDER BY partition_id, chunk) - 1)::BIGINT AS place FROM ch")
def l1_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.placed_chunks(_keys(embeddings(spark, sf_dir)), "partition_id", "key", 2, 1 << 20)


@query("batch_generator", "SELECT vec_id // 128 AS batch, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY 1")
def batch_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.frame_batches(embeddings(spark, sf_dir), 128).groupBy("batch").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


# ---------------------------------------------------------------- index families, training


def _exact(found: DataFrame, e: DataFrame, q: DataFrame) -> DataFrame:
    """Candidates with the distances of the vectors themselves, as codes give them only nearly."""
    both = found.select("qid", "vec_id").join(e.select("vec_id", "embedding"), "vec_id").join(q, "qid")
    return both.select("qid", "vec_id", V.l2(V.doubles(F.col("embedding")), V.doubles(F.col("qv"))).alias("distance"))


def _family(spark: SparkSession, sf_dir: str, options: IndexOptions, candidates: int = K) -> DataFrame:
    e = embeddings(spark, sf_dir)
    index, rest, _ = _index(e, options, 40)
    probes = routing.CentroidRouter(centroids(e)).probe(asked(e), PROBES)
    found = search_index(index, asked(e), probes, candidates, options).drop("rank")
    if candidates > K:
        found = _exact(found, e, asked(e))
    both = found.unionByName(vlog.probed_knn(rest, asked(e), probes, K).drop("rank"))
    return ranked(knn.merge_top_k(both, K))


@search("index_ivfflat_search")
def index_ivfflat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, IndexOptions("ivfflat", flat_up_to=16, lists=6, probes=6))


@query("index_ivfflat_all_lists", f"WITH {BASE}, {CENTROIDS}, {PROBE}, {LOG} {top(_HYBRID)}")
def index_ivfflat_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all lists of the probed partitions the result is that of searching these partitions."""
    return _family(spark, sf_dir, IndexOptions("ivfflat", flat_up_to=16, lists=6, probes=6))


@search("index_ivfpq_search")
def index_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, IndexOptions("ivfpq", flat_up_to=16, lists=4, probes=4, pq_from=16, pq_bits=5), 10 * K)


@search("index_hnsw_search")
def index_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, IndexOptions("hnsw", flat_up_to=16, links=8))


@query("kmeans_centroids")
def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = routing.train_centroids(embeddings(spark, sf_dir), LISTS)
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(c) for j, x in enumerate(row)], "partition_id int, i int, m double")


# ---------------------------------------------------------------- sources and streams


def _rows_sql(extra: str = "") -> str:
    return f"SELECT vec_id, (i - 1)::INT AS i, round(embedding[i]::DOUBLE, 6) + 0.0 AS x FROM embeddings, range(1, 65) t(i) {extra}"


def _long(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", r6(F.col("x").cast("double"), "x"))


@query("wire_frames", _rows_sql())
def wire_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("partition_id", F.col("label").cast("long"))
    return _long(records.from_frames(records.to_frames(e)))


def _engine(spark: SparkSession, sf_dir: str, files_a_batch: int) -> tuple[vlog.VectorLog, DataFrame]:
    """A log filled by a stream of four files."""
    e = embeddings(spark, sf_dir)
    root = workdir(spark, "stream")
    e.select("vec_id", "embedding").repartitionByRange(4, "vec_id").write.parquet(f"{root}/in")
    engine = vlog.VectorLog(spark, root, routing.CentroidRouter(centroids(e)), segment_bytes=5_000)
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", files_a_batch).parquet(f"{root}/in")
    engine.ingest_stream(stream, f"{root}/checkpoint").awaitTermination()
    return engine, e


@query("stream_ingest", f"WITH {BASE}, {CENTROIDS}, {ASSIGN} SELECT vec_id, p AS partition_id FROM a")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, 2)[0].log().select("vec_id", "partition_id")


_SEALED_STREAM = "SELECT partition_id, 18 * k AS segment_id, 18 * k AS base, 18 * k + 18 AS \"end\", 18::BIGINT AS n, 'flat' AS family FROM (SELECT p AS partition_id, unnest(range((count(*) - 1) // 18)) AS k FROM a GROUP BY p)"


@query("stream_seal_index", f"WITH {BASE}, {CENTROIDS}, {ASSIGN} {_SEALED_STREAM}")
def stream_seal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, 2)[0].manifest().select("partition_id", "segment_id", "base", "end", "n", "family")


@search("stream_search", f"WITH {BASE}, {CENTROIDS}, {ASSIGN}, {PROBE} {top(_IVF_PAIRS.format(n=PROBES))}")
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index and tail, whatever the cut between them, give what a search of the partitions gives."""
    engine, e = _engine(spark, sf_dir, 2)
    return ranked(engine.search(asked(e), K, PROBES))


@query("stream_replay", "SELECT count(*) AS n, count(DISTINCT vec_id) AS different FROM embeddings")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is delivered again leaves the log as it was."""
    engine, _ = _engine(spark, sf_dir, 1)
    last = engine.log().agg(F.max("batch")).first()[0]
    rows = spark.read.parquet(f"{engine.root}/in").join(engine.log().where(F.col("batch") == last).select("vec_id"), "vec_id", "left_semi")
    engine.append(rows, last)
    return engine.log().agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("different"))


def _vector_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The table written as vector files, by its tasks, and read back; its ids are row numbers already."""
    files.register(spark)
    path = workdir(spark, kind)
    files.write_vectors(embeddings(spark, sf_dir), path, kind)
    return _long(spark.read.format(kind).option("split", "512").load(path))


@query("fbin_shape", "SELECT count(*) AS n, max(len(embedding))::BIGINT AS dimension FROM embeddings")
def fbin_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and dimension of the vectors of a file, from its header alone."""
    e = embeddings(spark, sf_dir)
    path = workdir(spark, "fbin")
    files.write_vectors(e, path, "fbin", 1)
    return spark.createDataFrame([tuple(int(x) for x in files.probe(files.members(path, "fbin")[0]))], "n long, dimension long")


@query("fbin_scan", _rows_sql())
def fbin_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_files(spark, sf_dir, "fbin")


@query("npy_scan", _rows_sql())
def npy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_files(spark, sf_dir, "npy")
