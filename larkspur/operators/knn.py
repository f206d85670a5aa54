"""Exact nearest neighbours and the merging of partial results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.kernels import best, check_metric, matrix
from larkspur.session import importable

MOST_QUERIES = 20_000  #: queries of one batch; they go to every task, so their number is checked
RESULT = "qid long, vec_id long, distance double"


def in_blocks(queries: DataFrame, search: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """Union of ``search(cut)`` over ranges of qid with at most MOST_QUERIES different queries each.

    ``cut`` keeps a table's rows of the range. Only the ids of the queries go to the driver as a whole.
    """
    if queries.select("qid").limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        return search(lambda df: df)
    ids = np.unique(queries.select(F.col("qid").cast("long")).toArrow().column(0).to_numpy())
    ends = [(int(ids[at]), int(ids[min(at + MOST_QUERIES, len(ids)) - 1])) for at in range(0, len(ids), MOST_QUERIES)]
    return reduce(DataFrame.unionByName, [search(lambda df, a=a, b=b: df.where(F.col("qid").between(a, b))) for a, b in ends])


def query_matrix(queries: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a checked, bounded batch of queries (columns qid, qv), in order of qid."""
    most = MOST_QUERIES if most is None else most
    got = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>")).limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError(f"a batch holds at most {most} queries; split it")
    ids = got.column(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(got.column(1))[order] if len(ids) else np.zeros((0, 0))


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(qid, vec_id, distance): each task keeps k rows a query, then the partial results are merged.

    More than MOST_QUERIES queries are searched in blocks.
    """
    check_metric(metric)
    importable(vectors.sparkSession)
    return in_blocks(queries, lambda cut: _exact_knn(vectors, cut(queries), k, metric))


def _exact_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    qids, q = query_matrix(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            i, ids, d = best(q, matrix(b.column("embedding")), b.column("vec_id").to_numpy(), k, metric)
            if held is not None:
                i, ids, d = (np.r_[a, c] for a, c in zip(held, (i, ids, d), strict=True))
                o = np.lexsort((ids, d, i))
                i, ids, d = i[o], ids[o], d[o]
                keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < k
                i, ids, d = i[keep], ids[keep], d[keep]
            held = (i, ids, d)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"qid": qids[held[0]], "vec_id": held[1], "distance": held[2]})

    part = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, RESULT)
    return merge_top_k(part, k)


def probing(probes: DataFrame, qids: np.ndarray) -> dict[int, np.ndarray]:
    """Of each partition (qid, partition_id), the places in ``qids`` of the queries that probe it."""
    got = probes.select(F.col("qid").cast("long"), F.col("partition_id").cast("long")).distinct().toArrow()
    place, part = np.searchsorted(qids, got.column(0).to_numpy()), got.column(1).to_numpy()
    order = np.lexsort((place, part))
    names, starts = np.unique(part[order], return_index=True)
    return dict(zip(names.tolist(), np.split(place[order], starts[1:]), strict=True)) if len(names) else {}


def merge_top_k(partials: DataFrame, k: int) -> DataFrame:
    """The k nearest rows a query of any union of partial results, each vec_id once, with ranks from 1.

    The order is total, (distance, vec_id), so merging is associative: trees and flat unions agree.
    """
    one = partials.groupBy("qid", "vec_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("qid").orderBy("distance", "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", "distance")
