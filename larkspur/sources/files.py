"""Batch sources for vector files: ``fbin`` and ``npy`` as Python data sources, range by range.

``spark.read.format("fbin").load(path)`` gives (vec_id, embedding) with the row number as vec_id.
Options: ``rows`` (at most so many), ``start`` (first row), ``split`` (rows a partition, 100,000).
A file is a little-endian int32 pair (rows, dimension) and float32 rows, or an NPY matrix; a folder is
read as its files in order of name, rows numbered on. Paths go through pyarrow's file systems, so any
store it knows works; ranges are read without the rest. ``write_vectors`` writes such a folder, a file
a task.
"""

from __future__ import annotations

import ast
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur.operators.kernels import matrix
from larkspur.session import importable

SCHEMA = "vec_id long, embedding array<float>"
AT_ONCE = 4096


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_input(path: str):
    system, where = locate(path)
    return system.open_input_file(where)


def members(path: str, kind: str) -> list[str]:
    """The file itself, or a folder's files of this kind by name."""
    system, where = locate(path)
    if system.get_file_info(where).type != fs.FileType.Directory:
        return [path]
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(where)) if i.base_name.endswith(f".{kind}")]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names)]


def fbin_header(f) -> tuple[int, int, int, str]:
    """(rows, dimension, offset of the data, dtype)."""
    head = f.read(8)
    if len(head) < 8:
        raise ValueError("truncated fbin header")
    n, d = struct.unpack("<ii", head)
    if n < 0 or d <= 0:
        raise ValueError("bad fbin header")
    return n, d, 8, "<f4"


def npy_header(f) -> tuple[int, int, int, str]:
    head = f.read(10)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    if head[6] == 1:
        size, at = struct.unpack("<H", head[8:10])[0], 10
    else:
        size, at = struct.unpack("<I", head[8:10] + f.read(2))[0], 12
    info = ast.literal_eval(f.read(size).decode("latin-1"))
    if info["fortran_order"] or len(info["shape"]) != 2:
        raise ValueError("an npy source must be a matrix in row order")
    return *info["shape"], at + size, info["descr"]


HEADERS = {"fbin": fbin_header, "npy": npy_header}


def probe(path: str) -> tuple[int, int]:
    """(rows, dimension) from the header alone."""
    with open_input(path) as f:
        return HEADERS["fbin" if path.endswith(".fbin") else "npy"](f)[:2]


class Rows(InputPartition):
    """Rows [start, end) of a file whose first row has number ``first``."""

    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class VectorReader(DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str]):
        self.kind = kind
        self.split = max(1, int(options.get("split", 100_000)))
        low = int(options.get("start", 0))
        high = low + int(options["rows"]) if "rows" in options else None
        self.parts, first = [], 0
        for path in members(options["path"], kind):
            with open_input(path) as f:
                n = HEADERS[kind](f)[0]
            a, b = max(0, low - first), n if high is None else min(n, high - first)
            self.parts += [Rows(path, first, x, min(b, x + self.split)) for x in range(a, b, self.split)]
            first += n

    def partitions(self) -> list[InputPartition]:
        return self.parts or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        with open_input(partition.path) as f:
            _, d, at, dtype = HEADERS[self.kind](f)
            size = np.dtype(dtype).itemsize * d
            f.seek(at + partition.start * size)
            for a in range(partition.start, partition.end, AT_ONCE):
                n = min(AT_ONCE, partition.end - a)
                data = f.read(n * size)
                if len(data) < n * size:
                    raise ValueError("truncated vector file")
                flat = pa.array(np.frombuffer(data, dtype).astype(np.float32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(partition.first + np.arange(a, a + n), pa.int64()), lists], ["vec_id", "embedding"])


class FbinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.name(), self.options)


class NpySource(FbinSource):
    @classmethod
    def name(cls) -> str:
        return "npy"


def register(spark: SparkSession) -> SparkSession:
    importable(spark)
    spark.dataSource.register(FbinSource)
    spark.dataSource.register(NpySource)
    return spark


def write_fbin(path: str, x: np.ndarray) -> None:
    """Write a small matrix as fbin (test inputs and centroids)."""
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", *x.shape) + np.ascontiguousarray(x, "<f4").tobytes())


def write_vectors(vectors: DataFrame, path: str, kind: str = "fbin", parts: int | None = None) -> DataFrame:
    """Write (vec_id, embedding) in order of vec_id as a folder of files, one for each task that has rows.

    Returns (file, rows). Ids are not stored: read back, rows are numbered from 0 in order. A task that
    runs again writes the same file again.
    """
    spark = importable(vectors.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    system, where = locate(path)
    system.create_dir(where, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x = np.vstack([matrix(b.column("embedding")) for b in held]).astype("<f4")
        name = f"part-{held[0].column('shard')[0].as_py():05}.{kind}"
        out = io.BytesIO()
        if kind == "npy":
            np.save(out, x)
        else:
            out.write(struct.pack("<ii", *x.shape) + x.tobytes())
        to, place = locate(f"{path.rstrip('/')}/{name}")
        with to.open_output_stream(place) as f:
            f.write(out.getvalue())
        yield pa.RecordBatch.from_pydict({"file": [name], "rows": pa.array([len(x)], pa.int64())})

    rows = vectors.select("vec_id", "embedding").repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    done = rows.withColumn("shard", F.spark_partition_id()).mapInArrow(run, "file string, rows long").toArrow()
    return spark.createDataFrame(done.to_pylist(), "file string, rows long")
