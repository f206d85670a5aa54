"""Numpy kernels on Arrow batches for bulk distance work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

METRICS = ("euclidean", "cosine", "ip")
CELLS = 1 << 22  #: distances held at once


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a float64 matrix; rows of different lengths, null rows and null components raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    size = pc.min_max(pc.list_value_length(column)).as_py()
    flat = column.flatten()
    if column.null_count or flat.null_count or size["min"] != size["max"]:
        raise ValueError("vectors must not be or hold null and must have one dimension")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def unit(x: np.ndarray, zero: float) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, zero, n)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(queries, vectors): Euclidean distance, 1 - cos, or negative inner product."""
    if metric == "euclidean":
        square = (q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1)[None, :]
        return np.sqrt(np.maximum(square, 0))
    if metric == "cosine":
        if (np.linalg.norm(q, axis=1) == 0).any():
            raise ValueError("a query vector is zero")
        return 1 - unit(q, 1.0) @ unit(x, 1.0).T
    return -(q @ x.T)


def exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows without cancellation."""
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(1))
    dots = (x * q).sum(1)
    if metric == "ip":
        return -dots
    nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    return 1 - dots / (np.where(nx == 0, 1, nx) * nq)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of x for each query, as (query row, id, distance); equal distances go to the smaller id."""
    if not len(x) or not len(q) or k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    step = max(1, CELLS // len(x))
    if len(q) > step:
        parts = [best(q[at : at + step], x, ids, k, metric) for at in range(0, len(q), step)]
        return np.concatenate([p[0] + n * step for n, p in enumerate(parts)]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    d = distances(q, x, metric)
    m = min(k, len(x))
    edge = np.partition(d, m - 1, axis=1)[:, m - 1]
    i, j = np.nonzero(d <= (edge + 1e-6 * (1 + np.abs(edge)))[:, None])
    fine = exact(q[i], x[j], metric)
    o = np.lexsort((ids[j], fine, i))
    i, j, fine = i[o], j[o], fine[o]
    first = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - first[i] < m
    return i[keep], ids[j[keep]], fine[keep]


def nearest(x: np.ndarray, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row and its distance; ties go to the smaller number."""
    i, c, d = best(x, centroids, np.arange(len(centroids)), 1, metric)
    return c, d
