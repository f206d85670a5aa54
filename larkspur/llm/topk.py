"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are floor(256 x) in every component. For a segmentation of the dimensions, the means m and
deviations s of two vectors' segments of length l give a lower bound of their squared distance,
sum l ((m_q - m_x)^2 + (s_q - s_x)^2), so an upper bound of their inner product. Bounds are taken coarse
to fine; pairs whose bound stays below the query's k-th best score so far are dropped, and only the
survivors are multiplied out in integers.

Rows are packed into blocks of vectors; every query block meets every block of candidates. Query blocks go
to the candidates in rounds of about ROUND bytes, so what the driver and a task hold at once does not grow
with the tables; no other block is collected anywhere. Of equal vectors only the rows of the k + 1 smallest
ids are candidates: they have one score, so no other row of them can be among a query's k best.

Defined cases: a vector that is null, or holds a null or non-finite component, and a row with a null
vec_id take no part; vectors of different lengths do not meet; every repeated candidate row is a row of
its own, every repeated query id is one query (of the smallest vector); equal scores go to the smaller
vec_id; components of any finite size are multiplied exactly, and a score beyond a long is held at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, partitions, tune

LEVELS = (2, 8, 16)  #: segments of the bounds, coarse to fine
QUERIES, CANDIDATES = 256, 2048  #: vectors in a block
PAIRS = 1 << 15  #: pairs multiplied at a time
TILE = (32, 256)  #: queries and candidates
HELD = 1 << 22  #: best rows a task keeps before it passes those of a query block on
WIDE = 256  #: components of a vector beyond which blocks hold fewer vectors
ROUND = 4 << 20  #: bytes of query blocks sent to all tasks at once
LONGEST = (1 << 63) - 1


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def _pack(size: int):
    """Rows (vec_id, v) to blocks (dim, n, ids, matrix) of at most ``size`` vectors of one length, fewer of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids = np.array([r[0] for r in rows], np.int64)
            mat = np.floor(np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim) * 256)
            kind = "<i4" if not mat.size or np.abs(mat).max() < 1 << 31 else "<f8"  # whole numbers in either
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([mat.astype(kind).tobytes()], pa.binary())})

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) >= size or len(rows) * len(v) >= size * WIDE:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


BLOCK = "dim int, n int, ids binary, matrix binary"


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(l) m and sqrt(l) s, so that the bound is a plain squared distance of rows."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(np.int64))
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / size
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, dev]) * np.sqrt(np.r_[size, size])


def pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of b, a bounded number at a time."""
    out = np.empty(len(i), np.result_type(a, b))
    for at in range(0, len(i), PAIRS):
        k = slice(at, at + PAIRS)
        out[k] = np.einsum("ij,ij->i", a[i[k]], b[j[k]])
    return out


def tile_products(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, in the tiles that hold a pair that is alive; 0 elsewhere."""
    out = np.zeros(alive.shape, np.result_type(a, b))
    for r in range(0, alive.shape[0], TILE[0]):
        for c in range(0, alive.shape[1], TILE[1]):
            cell = slice(r, r + TILE[0]), slice(c, c + TILE[1])
            if alive[cell].any():
                out[cell] = a[cell[0]] @ b[cell[1]].T
    return out


def exact_forms(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as the fastest of float64, int64 and Python's integers in which their products are exact."""
    most = int(np.abs(q).max()) * int(np.abs(x).max()) * q.shape[1] if q.size and x.size else 0
    if most < 1 << 53:
        return np.asarray(q, np.float64), np.asarray(x, np.float64)
    if most < 1 << 63:
        return q.astype(np.int64), x.astype(np.int64)
    return tuple(np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (q, x))


class Block:
    """A block's ids and vectors, their norms and, once asked for, the statistics of each level."""

    def __init__(self, ids: bytes, n: int, dim: int, data: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.v = np.frombuffer(data, "<f8" if len(data) == 8 * n * dim and dim else "<i4").reshape(n, dim)
        self.floats = np.asarray(self.v, np.float64)
        self.norms = (self.floats * self.floats).sum(1)
        self.most = int(np.abs(self.floats).max()) if self.v.size else 0
        self.forms: dict[tuple, np.ndarray] = {}

    def statistics(self, segments: int, kind: type) -> np.ndarray:
        if (segments, kind) not in self.forms:
            self.forms[segments, kind] = statistics(self.floats, segments).astype(kind)
        return self.forms[segments, kind]

    def singles(self) -> np.ndarray:
        if () not in self.forms:
            self.forms[()] = self.v.astype(np.float32)
        return self.forms[()]


def search_block(q: Block, x: Block, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, scores and ids that can be among their k best, given that ``floor`` is reached elsewhere."""
    small = q.most * x.most * q.v.shape[1] < 1 << 24  # products and their sums are exact in float32
    kind, part, least = (np.float32, 1e-5, 4.0) if small else (np.float64, 1e-9, 1e-6)
    qe, xe = (q.singles(), x.singles()) if small else exact_forms(q.v, x.v)
    slack_q, slack_x = part * q.norms + least, (part * x.norms).astype(kind)
    alive = q.ids[:, None] != x.ids[None, :]
    floor = floor.copy()

    def limit() -> np.ndarray:
        return np.minimum(floor, LONGEST - 2048)  # scores held at a long's end tie

    for segments in LEVELS:
        bound = tile_products(q.statistics(segments, kind), x.statistics(segments, kind), alive)  # (|q|^2 + |x|^2 - lower bound of the distance) / 2
        new = np.flatnonzero(floor == -np.inf)
        if len(new) and len(x.ids) >= k:  # the candidates with the best bounds make the first floor
            top = np.argpartition(np.where(alive[new], -bound[new], np.inf), k - 1, axis=1)[:, :k]
            s = pair_products(qe, xe, np.repeat(new, k), top.ravel()).reshape(len(new), k).astype(np.float64)
            s[~np.take_along_axis(alive[new], top, 1)] = -np.inf
            floor[new] = s.min(1)
        alive &= bound + slack_x >= (limit() - slack_q)[:, None].astype(kind)
    score = tile_products(qe, xe, alive)
    if score.dtype in (np.float32, np.float64):
        alive &= score >= limit()[:, None].astype(score.dtype)
    i, j = np.nonzero(alive)
    score = score[i, j]
    score = np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in score.tolist()], np.int64) if score.dtype == object else score.astype(np.int64)
    return i, score, x.ids[j]


class Best:
    """The k best (row, score, id) of each query of a block so far; ``floor`` is a query's k-th best score."""

    def __init__(self, q: Block):
        self.q = q
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(q.ids), -np.inf)

    def meet(self, x: Block, k: int) -> None:
        found = search_block(self.q, x, k, self.floor)
        if not len(found[0]):
            return
        row, score, ids = (np.r_[a, b] for a, b in zip((self.row, self.score, self.id), found, strict=True))
        o = np.lexsort((ids, -np.maximum(score, -LONGEST), row))
        row, score, ids = row[o], score[o], ids[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.floor[row[rank == k - 1]] = score[rank == k - 1]
        self.row, self.score, self.id = row[rank < k], score[rank < k], ids[rank < k]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": self.q.ids[self.row], "vec_id": self.id, "score": self.score})


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, Best] = {}  # by query block, the one used last at the end
        last, x = None, None
        for b in batches:
            for r in b.to_pylist():
                if last != (r["ids"], r["matrix"]):
                    last = r["ids"], r["matrix"]
                    x = Block(r["ids"], r["n"], r["dim"], r["matrix"])
                mine = best.pop(r["q_ids"], None) or Best(Block(r["q_ids"], r["q_n"], r["dim"], r["q_matrix"]))
                mine.meet(x, k)
                best[r["q_ids"]] = mine
                while len(best) > max(1, HELD // (QUERIES * max(1, k))):
                    yield best.pop(next(iter(best))).rows()
        for mine in best.values():
            yield mine.rows()

    return run


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``embeddings`` with the largest integer inner products."""
    spark = embeddings.sparkSession
    tune(spark)

    def rows(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))

    # of equal vectors the rows of the k + 1 smallest ids: one may be the query's own
    equal = Window.partitionBy("h", "v").orderBy("vec_id")
    first = rows(embeddings).withColumn("h", F.xxhash64("v")).withColumn("n", F.dense_rank().over(equal)).where(F.col("n") <= k + 1).select("vec_id", "v")
    cand = materialize(first.mapInArrow(_pack(CANDIDATES), BLOCK).repartition(partitions(embeddings)), "topk-x")
    asked = rows(queries).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_pack(QUERIES), BLOCK)
    asked = materialize(asked.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("n", "ids", "matrix"))), "topk-q")
    # rounds by the blocks' own bytes: what a table takes on disk tells little of repeated vectors
    blocks, size = asked.agg(F.count("*"), F.sum(F.octet_length("q_matrix") + F.octet_length("q_ids"))).first()
    rounds = max(1, min(blocks, -(-(size or 0) // ROUND)))
    asked = asked.withColumn("round", F.pmod(F.xxhash64("q_ids"), F.lit(rounds)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = None
    for turn in range(rounds):
        some = asked.where(F.col("round") == turn).drop("round")
        found = cand.join(F.broadcast(some), "dim").mapInArrow(_search(k), "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if rounds > 1:
            found = materialize(found, "topk-found")
        out = found if out is None else out.union(found)
    return out


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
