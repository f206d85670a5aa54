"""What the operators of this package share: intermediate tables, batch sizes, document keys."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import importable

#: Stands for a null doc_id wherever documents are ordered: such rows come last.
NULL_ID = (1 << 63) - 1
PLACES = 1 << 25  #: bits of the filter that keeps texts out of shuffles
IS_SET = "shiftright(cast(conv(hex(substring(_bits, cast(_p div 8 as int) + 1, 1)), 16, 10) as int), cast(_p % 8 as int)) & 1 = 1"

_own_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Session settings that bound memory and disk; none of them changes a result.

    Arrow batches are bounded by bytes, so that long texts cannot fill a Python worker, and
    shuffle files go as soon as the execution that wrote them ends (every later use reads a
    written table, never an old shuffle).
    """
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); an own one only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="larkspur-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        base = _own_dirs[app]
    return base.rstrip("/")


def materialize(df: DataFrame, what: str, *, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    for tables in _recording:
        tables.append(out)
    return out


_recording: list[list[DataFrame]] = []


@contextmanager
def recorded(tables: list[DataFrame]) -> Iterator[None]:
    """Note in ``tables`` what ``materialize`` writes meanwhile."""
    _recording.append(tables)
    try:
        yield
    finally:
        _recording.remove(tables)


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing will read it any more."""
    for df in tables:
        path = getattr(df, "_larkspur_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A batch's texts as UTF-8 bytes, null as empty."""
    values = batch.column(column).cast(pa.binary()).to_pylist()
    return [b"" if v is None else v for v in values]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a Python worker gives freed memory back to the system instead of keeping it for its next task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return task


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array, and its length at the end."""
    if len(keys) == 0:
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 1) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` regrouped so that no key is cut; about ``at_least`` rows each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        if n >= at_least:
            last = held[-1].column(key)[-1].as_py()
            values = b.column(key).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(values != last, True)) if values[-1] != last else len(values)
            if cut < len(values):
                if cut:
                    held.append(b.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with is_set, which is true of all rows whose key is in ``keys`` and of few others.

    The filter has PLACES bits in all, so at most PLACES / 8 bytes go to every task, whatever the keys.
    """
    place = F.pmod(F.xxhash64(key), F.lit(PLACES))
    bits = keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    tagged_rows = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_p", F.bitmap_bit_position(place))
    return tagged_rows.join(F.broadcast(bits), "_bucket", "left").withColumn("is_set", F.coalesce(F.expr(IS_SET), F.lit(False))).drop("_bucket", "_bits", "_p")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text) -> F.Column:
    """Number of runs of bytes other than space and \\t \\n \\v \\f \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
