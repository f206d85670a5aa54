"""Routing of vectors and queries to partitions: nearest centroids, hyperplane hashing, hash tables.

A router turns a table into rows of (id, partition_id): ``assign`` for writing, ``ingest`` for writing
with replicas, ``probe`` for searching. Ranks follow (distance, partition_id) everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.kernels import best, check_metric, matrix, nearest, unit
from larkspur.session import importable

MOST_BITS = 32
MOST_BUCKETS = 1 << 20


class Router(Protocol):
    n_partitions: int

    def assign(self, vectors: DataFrame, carry: bool = False) -> DataFrame: ...

    def ingest(self, vectors: DataFrame, carry: bool = False) -> DataFrame: ...

    def probe(self, queries: DataFrame, nprobe: int) -> DataFrame: ...


def _rows(df: DataFrame, key: str, value: str, kernel, schema: str, carry: bool = False) -> DataFrame:
    """Apply ``kernel(ids, matrix) -> dict of columns`` to batches of (key, value).

    With ``carry`` the value goes along: the kernel then gives the row of the batch that each of its rows is from.
    """
    importable(df.sparkSession)
    base = df.select(F.col(key).cast("long").alias(key), value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = kernel(b.column(0).to_numpy(), matrix(b.column(1)))
                at = out.pop("row", None)
                if carry:
                    out[value] = b.column(1).take(pa.array(at))
                yield pa.RecordBatch.from_pydict(out)

    return base.mapInArrow(run, schema + (f", {value} {base.schema[value].dataType.simpleString()}" if carry else ""))


class CentroidRouter:
    """A partition for each centroid; vectors go to the nearest, queries to the nprobe nearest."""

    def __init__(self, centroids: np.ndarray, metric: str = "euclidean"):
        check_metric(metric)
        centroids = np.asarray(centroids, np.float64)
        if centroids.ndim != 2 or not len(centroids):
            raise ValueError("centroids must be a matrix with a row for each partition")
        self.centroids, self.metric, self.n_partitions = centroids, metric, len(centroids)

    def assign(self, vectors: DataFrame, carry: bool = False) -> DataFrame:
        """vec_id, partition_id, distance of every row; ``carry`` adds its embedding."""
        c, metric = self.centroids, self.metric

        def kernel(ids: np.ndarray, x: np.ndarray) -> dict:
            p, d = nearest(x, c, metric)
            return {"vec_id": ids, "partition_id": p.astype(np.int64), "distance": d, "row": np.arange(len(ids))}

        return _rows(vectors, "vec_id", "embedding", kernel, "vec_id long, partition_id long, distance double", carry)

    def ingest(self, vectors: DataFrame, carry: bool = False) -> DataFrame:
        return self.assign(vectors, carry).drop("distance")

    def probe(self, queries: DataFrame, nprobe: int) -> DataFrame:
        c, metric, n = self.centroids, self.metric, max(0, min(nprobe, self.n_partitions))

        def kernel(ids: np.ndarray, x: np.ndarray) -> dict:
            i, p, d = best(x, c, np.arange(len(c)), n, metric)
            rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(x)))[i] + 1
            return {"qid": ids[i], "rank": rank.astype(np.int32), "partition_id": p.astype(np.int64), "distance": d}

        return _rows(queries, "qid", "qv", kernel, "qid long, rank int, partition_id long, distance double")


def hyperplanes(dimension: int, bits: int, seed: int = 42, tables: int | None = None) -> np.ndarray:
    """Seeded normal projections: (dimension, bits), or (tables, dimension, bits)."""
    shape = (dimension, bits) if tables is None else (tables, dimension, bits)
    return np.random.default_rng(seed).standard_normal(shape)


class HashRouter:
    """Hyperplane hashing with one or more tables.

    A bucket (the sign bits of a table's projections) belongs to a partition. Vectors go to their
    bucket's partition in every table; queries probe by the least Hamming distance of a partition's
    buckets, where a partition without buckets is bits + 1 away.
    """

    def __init__(self, n_partitions: int, dimension: int, bits: int, tables: int = 1, seed: int = 42, metric: str = "euclidean", planes: np.ndarray | None = None):
        check_metric(metric)
        if not 0 < bits <= MOST_BITS:
            raise ValueError(f"bits must be 1 to {MOST_BITS}")
        if tables < 1 or n_partitions < 1:
            raise ValueError("tables and partitions must be positive")
        self.n_partitions, self.bits, self.tables, self.metric = n_partitions, bits, tables, metric
        self.planes = hyperplanes(dimension, bits, seed, tables) if planes is None else planes

    def code_matrix(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows) hash codes."""
        if self.metric == "cosine":
            x = unit(x, 1.0)
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return np.stack([(x @ p >= 0) @ weights for p in self.planes])

    def bucket_partitions(self, codes: np.ndarray) -> np.ndarray:
        return codes if 1 << self.bits == self.n_partitions else codes % self.n_partitions

    def partition_distances(self, codes: np.ndarray) -> np.ndarray:
        """(rows, partitions): least Hamming distance of each partition's buckets to each code."""
        n, bits = self.n_partitions, self.bits
        if n & (n - 1) == 0 and n <= 1 << bits:
            # partitions are the codes' low bits and the rest of a bucket is free
            return np.bitwise_count((codes[:, None] ^ np.arange(n)) & (n - 1)).astype(np.int64)
        if 1 << bits > MOST_BUCKETS:
            raise ValueError("so many bits need a number of partitions that is a power of two")
        buckets = np.arange(1 << bits)
        out = np.full((len(codes), n), bits + 1, np.int64)
        where = self.bucket_partitions(buckets)
        for r, c in enumerate(codes):
            np.minimum.at(out[r], where, np.bitwise_count(c ^ buckets).astype(np.int64))
        return out

    def codes(self, df: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
        """(key, table, code)."""

        def kernel(ids: np.ndarray, x: np.ndarray) -> dict:
            c = self.code_matrix(x)
            return {key: np.tile(ids, len(c)), "table": np.repeat(np.arange(len(c), dtype=np.int32), len(ids)), "code": c.ravel()}

        return _rows(df, key, value, kernel, f"{key} long, table int, code long")

    def assign(self, vectors: DataFrame, carry: bool = False) -> DataFrame:
        """The first table's partition alone; ``carry`` adds the embedding."""
        return self._placed(vectors, False, carry)

    def ingest(self, vectors: DataFrame, carry: bool = False) -> DataFrame:
        """A row for each different partition among the tables' buckets; ``carry`` adds the embedding."""
        return self._placed(vectors, True, carry)

    def _placed(self, vectors: DataFrame, replicas: bool, carry: bool) -> DataFrame:
        def kernel(ids: np.ndarray, x: np.ndarray) -> dict:
            p = self.bucket_partitions(self.code_matrix(x) if replicas else self.code_matrix(x)[:1])
            new = np.array([[(p[:t, i] != p[t, i]).all() for i in range(len(ids))] for t in range(len(p))], bool)
            new = new.ravel()
            return {"vec_id": np.tile(ids, len(p))[new], "partition_id": p.ravel()[new].astype(np.int64), "row": np.tile(np.arange(len(ids)), len(p))[new]}

        return _rows(vectors, "vec_id", "embedding", kernel, "vec_id long, partition_id long", carry)

    def choose(self, codes: np.ndarray, nprobe: int) -> list[tuple[int, int]]:
        """Partitions for a query with one code a table, nearest first, as (distance, partition).

        Every table nominates its share of partitions; if these are fewer than asked for, tables take
        turns in naming their next best that nobody has named. The union is ordered by least distance
        over all tables and cut.
        """
        want = max(0, min(nprobe, self.n_partitions))
        if not want:
            return []
        d = np.stack([self.partition_distances(np.array([c]))[0] for c in codes])
        ranked = [np.lexsort((np.arange(self.n_partitions), row)).tolist() for row in d]
        share = -(-want // len(codes))
        named = {p for r in ranked for p in r[:share]}
        queues = [iter(r[share:]) for r in ranked]
        while len(named) < want:
            for q in queues:
                if len(named) >= want:
                    break
                p = next((p for p in q if p not in named), None)
                if p is not None:
                    named.add(p)
        return sorted((int(d[:, p].min()), p) for p in named)[:want]

    def probe(self, queries: DataFrame, nprobe: int) -> DataFrame:
        def kernel(ids: np.ndarray, x: np.ndarray) -> dict:
            codes = self.code_matrix(x).T
            rows = [(q, r, p, float(d)) for q, c in zip(ids.tolist(), codes, strict=True) for r, (d, p) in enumerate(self.choose(c, nprobe), 1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            return {"qid": pa.array(cols[0], pa.int64()), "rank": pa.array(cols[1], pa.int32()), "partition_id": pa.array(cols[2], pa.int64()), "distance": pa.array(cols[3], pa.float64())}

        return _rows(queries, "qid", "qv", kernel, "qid long, rank int, partition_id long, distance double")


def hash_probe_table(codes: DataFrame, bits: int, n_partitions: int, nprobe: int) -> DataFrame:
    """(qid, rank, partition_id, distance) of one table's query codes (qid, code), as joins alone; at most MOST_BUCKETS buckets are sent to all tasks."""
    if 1 << bits > MOST_BUCKETS or n_partitions > MOST_BUCKETS or nprobe < 0:
        raise ValueError(f"there can be {MOST_BUCKETS} buckets and partitions at most, and no negative number of probes")
    spark = codes.sparkSession
    bucket = spark.range(1 << bits).select(F.col("id").alias("bucket"))
    where = bucket.withColumn("p", F.col("bucket") if 1 << bits == n_partitions else F.pmod("bucket", F.lit(n_partitions)))
    parts = spark.range(n_partitions).select(F.col("id").alias("partition_id"))
    near = codes.crossJoin(F.broadcast(parts)).join(F.broadcast(where), F.col("p") == F.col("partition_id"), "left")
    least = near.groupBy("qid", "partition_id").agg(F.coalesce(F.min(F.bit_count(F.col("code").bitwiseXOR(F.col("bucket")))), F.lit(bits + 1)).cast("long").alias("distance"))
    order = Window.partitionBy("qid").orderBy("distance", "partition_id")
    return least.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nprobe).select("qid", F.col("rank").cast("int").alias("rank"), "partition_id", "distance")


def train_centroids(vectors: DataFrame, k: int, rows: int = 100_000, seed: int = 42) -> np.ndarray:
    """k-means centres of the first ``rows`` vectors by vec_id (a documented bound on what is fitted)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = vectors.orderBy("vec_id").limit(rows).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, seed=seed).fit(some).clusterCenters())


def load_centroids(spark: SparkSession, path: str) -> np.ndarray:
    """Centres of an ``npy`` file, or of Parquet rows (label, embedding) in order of label; two dimensions, or ValueError."""
    if path.endswith(".npy"):
        centres = np.load(path)
    else:
        rows = spark.read.parquet(path).select("label", "embedding").orderBy("label").collect()  # centroids are few by design
        if len({len(r["embedding"]) for r in rows}) > 1:
            raise ValueError("centroids differ in length")
        centres = np.array([r["embedding"] for r in rows], np.float64)
    if centres.ndim != 2 or not centres.size:
        raise ValueError(f"centroids must be a matrix, not of shape {centres.shape}")
    return centres


def centroid_router(vectors: DataFrame, k: int | None = None, path: str | None = None, metric: str = "euclidean") -> CentroidRouter:
    """A router by the centroids of a file or by k trained ones, one of both."""
    if (k is None) == (path is None):
        raise ValueError("give either a number of centroids or a file of them")
    return CentroidRouter(train_centroids(vectors, k) if path is None else load_centroids(vectors.sparkSession, path), metric)


def label_centroids(vectors: DataFrame) -> DataFrame:
    """(label, i, m): mean of each dimension by label, one step of k-means from given assignments."""
    x = vectors.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return x.groupBy("label", "i").agg(F.avg("x").alias("m"))


def as_matrix(centroids: DataFrame) -> np.ndarray:
    """(label, i, m) rows as a matrix in order of label; the number of centroids is small by design."""
    got = centroids.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).orderBy("label").collect()
    return np.array([[x["m"] for x in r["v"]] for r in got])
