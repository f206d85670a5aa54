"""A partitioned, append-only vector log with sealed segments, their indexes, and search over both.

Tables under a root folder:

* ``log``: partition_id, log_offset, vec_id, embedding, batch; one folder a micro-batch, written by
  overwriting, so a replayed batch leaves what it left before, and in it one a partition;
* ``manifest``: partition_id, segment_id (= base), base, end, n, family, and the index payload; a
  segment is indexed and committed by the same row, so index and log tail are always disjoint and
  together complete. It has the same folders;
* ``heads``: partition_id, head after each micro-batch, so the next one does not read the log.

Log and manifest are read by partition: the probed partitions are literals of the scan, so files of other
partitions are not opened, and so are committed offsets, so that sealed row groups are skipped.

A search reads one manifest snapshot; rows at or above a partition's last sealed end are its tail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.index import IndexOptions, build_index, search_index
from larkspur.operators.kernels import best, matrix
from larkspur.operators.knn import RESULT, in_blocks, merge_top_k, probing, query_matrix
from larkspur.operators.routing import Router
from larkspur.session import importable
from larkspur.sources import records

LOG = "partition_id long, log_offset long, vec_id long, embedding array<float>, batch long"
HEADS = "partition_id long, head long"
MANIFEST = "partition_id long, segment_id long, base long, end long, n long, family string, payload binary, batch long"


# ---------------------------------------------------------------- offsets


def append_offsets(placed: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Add log_offset: rows of a partition in order of vec_id, after the partition's head (partition_id, head)."""
    order = Window.partitionBy("partition_id").orderBy("vec_id")
    rows = placed.withColumn("log_offset", F.row_number().over(order).cast("long") - 1)
    if heads is None:
        return rows
    return rows.join(heads, "partition_id", "left").withColumn("log_offset", F.col("log_offset") + F.coalesce("head", F.lit(0))).drop("head")


def end_offsets(log: DataFrame) -> DataFrame:
    """(partition_id, end_offset): the next offset to be written."""
    return log.groupBy("partition_id").agg((F.max("log_offset") + 1).alias("end_offset"))


def start_offsets(log: DataFrame, committed: DataFrame) -> DataFrame:
    """(partition_id, start_offset): the committed offset, not below the first row's; the first row's if none."""
    low = log.groupBy("partition_id").agg(F.min("log_offset").alias("low"))
    both = low.join(committed.select("partition_id", "committed"), "partition_id", "left")
    return both.select("partition_id", F.greatest(F.coalesce("committed", "low"), F.col("low")).alias("start_offset"))


def tail(log: DataFrame, starts: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Rows of [start_offset, end_offset) of each partition."""
    rows = log.join(starts, "partition_id").where(F.col("log_offset") >= F.col("start_offset"))
    if ends is not None:
        rows = rows.join(ends, "partition_id").where(F.col("log_offset") < F.col("end_offset"))
    return rows.select(*log.columns)


# ---------------------------------------------------------------- sealing


def seal_rows(log: DataFrame, rows: int) -> DataFrame:
    """Log rows in full segments of ``rows`` rows, with segment_id (= base offset)."""
    place = Window.partitionBy("partition_id").orderBy("log_offset")
    numbered = log.withColumn("segment", F.floor((F.row_number().over(place) - 1) / rows).cast("long"))
    group = Window.partitionBy("partition_id", "segment")
    full = numbered.withColumn("size", F.count("*").over(group)).where(F.col("size") == rows)
    return full.withColumn("segment_id", F.min("log_offset").over(group)).drop("segment", "size")


def seal_bytes(log: DataFrame, limit: int, size: Column | None = None) -> DataFrame:
    """(partition_id, base, end, bytes, sealed): greedy segments, closed by the row that would pass ``limit`` bytes.

    The open segment of each partition comes last, not sealed. A partition's rows are read as a stream,
    in order of offset, with the open segment as the only state.
    """
    spark = importable(log.sparkSession)
    size = F.lit(8) + 4 * F.size("embedding") if size is None else size

    def run(batches):
        now, out = None, []
        for b in batches:
            for p, at, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now[0] != p:
                    if now:
                        out.append((*now, False))
                    now = (p, at, at + 1, n)
                elif now[3] + n > limit:
                    out.append((*now, True))
                    now = (p, at, at + 1, n)
                else:
                    now = (p, now[1], at + 1, now[3] + n)
        if now:
            out.append((*now, False))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in cols[:4]), pa.array(list(cols[4]), pa.bool_())], ["partition_id", "base", "end", "bytes", "sealed"])

    rows = log.select(F.col("partition_id").cast("long"), F.col("log_offset").cast("long"), size.cast("long").alias("bytes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "partition_id").sortWithinPartitions("partition_id", "log_offset").mapInArrow(run, "partition_id long, base long, end long, bytes long, sealed boolean")


def segment_manifest(sealed: DataFrame) -> DataFrame:
    """(partition_id, segment_id, base, end, n) of sealed rows; [base, end) is half open."""
    return sealed.groupBy("partition_id", "segment_id").agg(F.min("log_offset").alias("base"), (F.max("log_offset") + 1).alias("end"), F.count("*").alias("n"))


def registry(manifest: DataFrame, prefix: str = "idx") -> DataFrame:
    """(partition, keys) of manifest rows (partition_id, base): index keys in order, by name of their folder."""
    folder = F.concat(F.lit("partition_"), F.col("partition_id"))
    key = F.concat_ws("/", F.lit(prefix), folder, F.concat(F.lit("index_"), F.col("base"), F.lit(".ann")))
    return manifest.select(folder.alias("partition"), key.alias("key")).distinct().groupBy("partition").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def registered(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifest rows of ``old`` and those of ``new`` whose (partition_id, segment_id) is not there yet."""
    return old.unionByName(new.join(old.select("partition_id", "segment_id"), ["partition_id", "segment_id"], "left_anti"))


def committed_offsets(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("partition_id").agg(F.max("end").alias("committed"))


# ---------------------------------------------------------------- the engine


@dataclass
class VectorLog:
    """Ingest, seal, index and search one collection under ``root``."""

    spark: SparkSession
    root: str
    router: Router
    segment_bytes: int = 7_500_000
    options: IndexOptions = IndexOptions()

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(*(c.split()[0] for c in schema.split(", ")))

    def create(self) -> None:
        """Make an empty collection; FileExistsError if there is one."""
        fs, root = self._folder()
        if fs.exists(root):
            raise FileExistsError(self.root)
        fs.mkdirs(root)

    def delete(self) -> None:
        """Delete the collection with its log and its indexes; nothing if there is none."""
        fs, root = self._folder()
        fs.delete(root, True)

    def _folder(self):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def manifest(self) -> DataFrame:
        return self._read("manifest", MANIFEST)

    def append(self, vectors: DataFrame, batch: int) -> None:
        """Route a batch, give offsets after those of earlier batches, write it; repeating a batch changes nothing.

        Every row is logged once for each of its partitions, rows that repeat a vec_id too.
        """
        self._write(self.router.ingest(vectors, carry=True), batch)

    def append_to(self, vectors: DataFrame, batch: int, partition: int) -> None:
        """Write a whole batch to one partition, whatever the router says (for debugging a partition)."""
        if not 0 <= partition < self.router.n_partitions:
            raise ValueError(f"there are partitions 0 to {self.router.n_partitions - 1}")
        self._write(vectors.withColumn("partition_id", F.lit(partition).cast("long")), batch)

    def _write(self, placed: DataFrame, batch: int) -> None:
        """Write a batch and the heads after it; a batch that stops between the two is delivered again."""
        heads, path = self._heads(batch), f"{self.root}/log/batch={batch}"
        rows = append_offsets(placed, heads)
        rows.select("partition_id", "log_offset", "vec_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").partitionBy("partition_id").parquet(path)
        written = self.spark.read.schema("partition_id long, log_offset long").parquet(path)
        after = end_offsets(written).withColumnRenamed("end_offset", "head").unionByName(heads)
        after.groupBy("partition_id").agg(F.max("head").alias("head")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/heads/batch={batch}")

    def _heads(self, batch: int) -> DataFrame:
        """(partition_id, head) after the last batch before this one."""
        fs, root = self._folder()
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "heads")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        before = [n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if n < batch]
        if not before:
            return self.spark.createDataFrame([], HEADS)
        return self.spark.read.schema(HEADS).parquet(f"{self.root}/heads/batch={max(before)}")

    def open_rows(self, manifest: DataFrame) -> DataFrame:
        """Log rows at or beyond the committed offsets of a manifest; these are literals, one a partition."""
        committed = {r["partition_id"]: r["committed"] for r in committed_offsets(manifest).collect()}
        beyond = [(F.col("partition_id") == p) & (F.col("log_offset") >= committed.get(p, 0)) for p in range(self.router.n_partitions)]
        while len(beyond) > 1:  # in pairs, so that the expression stays flat
            beyond = [x | y for x, y in zip(beyond[::2], beyond[1::2])] + beyond[len(beyond) // 2 * 2 :]
        return self.log().where(beyond[0])

    def index(self, batch: int) -> None:
        """Seal what is full beyond the committed offsets, build the segments' indexes and commit both at once."""
        open_rows = self.open_rows(self.manifest().where(F.col("batch") < batch))
        spans = seal_bytes(open_rows, self.segment_bytes).where("sealed").select("partition_id", "base", "end")
        rows = open_rows.join(spans, "partition_id").where((F.col("log_offset") >= F.col("base")) & (F.col("log_offset") < F.col("end"))).withColumn("segment_id", F.col("base"))
        built = build_index(rows, self.options).join(spans.withColumnRenamed("base", "segment_id"), ["partition_id", "segment_id"])
        built.select("partition_id", "segment_id", F.col("segment_id").alias("base"), "end", "n", "family", "payload").write.mode("overwrite").partitionBy("partition_id").parquet(f"{self.root}/manifest/batch={batch}")

    def ingest_stream(self, stream: DataFrame, checkpoint: str, seal: bool = True):
        """Start a query that appends every micro-batch and then seals and indexes; returns the StreamingQuery."""

        def each(df: DataFrame, batch: int) -> None:
            self.append(df, batch)
            if seal:
                self.index(batch)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def index_files(self, path: str, checkpoint: str):
        """Start a query that indexes sealed ``.log`` segments as they arrive under ``path``; returns the StreamingQuery.

        Partition and base are read from a segment's path; other files, paths that do not say them, and
        segments that are registered already are left out. A damaged segment stops the query.
        """

        def each(df: DataFrame, batch: int) -> None:
            _, partition, base, _ = records.segment_key(F.col("path"))
            rows = df.withColumn("partition_id", partition).withColumn("segment_id", base).where("partition_id IS NOT NULL AND segment_id IS NOT NULL")
            old = self.manifest().where(F.col("batch") < batch).select("partition_id", "segment_id")
            rows = rows.join(old, ["partition_id", "segment_id"], "left_anti")
            ends = rows.groupBy("partition_id", "segment_id").agg((F.max("log_offset") + 1).alias("end"))
            built = build_index(rows, self.options).join(ends, ["partition_id", "segment_id"])
            built.select("partition_id", "segment_id", F.col("segment_id").alias("base"), "end", "n", "family", "payload").write.mode("overwrite").partitionBy("partition_id").parquet(f"{self.root}/manifest/batch={batch}")

        stream = records.read_segments(self.spark, path, stream=True)
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def count_indexes(self) -> DataFrame:
        return self.manifest().groupBy("partition_id").agg(F.count("*").alias("indexes"))

    def registry(self) -> DataFrame:
        """(partition, keys): the current index keys of each partition, from the manifest alone."""
        return registry(self.manifest())

    def wait(self, query) -> int:
        """Wait until a running stream has taken all there is; returns the number of indexes."""
        query.processAllAvailable()
        return self.manifest().count()

    def cache(self) -> DataFrame:
        """Hold the current indexes in executor memory for repeated searches."""
        return self.manifest().persist()

    def index_search(self, queries: DataFrame, k: int, nprobe: int = 16, manifest: DataFrame | None = None) -> DataFrame:
        index = self.manifest() if manifest is None else manifest
        return search_index(index, queries, self.router.probe(queries, nprobe), k, self.options)

    def log_search(self, queries: DataFrame, k: int, nprobe: int = 16, manifest: DataFrame | None = None) -> DataFrame:
        """Exhaustive search of the probed partitions' rows that no index of the snapshot holds."""
        manifest = self.manifest() if manifest is None else manifest
        probes = self.router.probe(queries, nprobe).select("qid", "partition_id")
        return probed_knn(self.open_rows(manifest), queries, probes, k, self.options.metric)

    def search(self, queries: DataFrame, k: int, nprobe: int = 16, manifest: DataFrame | None = None) -> DataFrame:
        """(qid, rank, vec_id, distance) over index and tail, of one manifest snapshot."""
        manifest = self.manifest() if manifest is None else manifest
        both = self.index_search(queries, k, nprobe, manifest).unionByName(self.log_search(queries, k, nprobe, manifest))
        return merge_top_k(both.drop("rank"), k)


def probed_knn(rows: DataFrame, queries: DataFrame, probes: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """Exact top k of (qid, qv) among the rows (partition_id, vec_id, embedding) of each query's partitions."""
    importable(rows.sparkSession)
    return in_blocks(queries, lambda cut: _probed_knn(rows, cut(queries), cut(probes), k, metric))


def _probed_knn(rows: DataFrame, queries: DataFrame, probes: DataFrame, k: int, metric: str) -> DataFrame:
    qids, q = query_matrix(queries)
    asked = probing(probes, qids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("partition_id").to_numpy()
            x, ids = matrix(b.column("embedding")), b.column("vec_id").to_numpy()
            for p in np.unique(part):
                mine = asked.get(int(p))
                if mine is None:
                    continue
                here = np.flatnonzero(part == p)
                i, found, d = best(q[mine], x[here], ids[here], k, metric)
                yield pa.RecordBatch.from_pydict({"qid": qids[mine][i], "vec_id": found, "distance": d})

    placed = rows.select(F.col("partition_id").cast("long").alias("partition_id"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return merge_top_k(placed.where(F.col("partition_id").isin(list(asked))).mapInArrow(run, RESULT), k)
