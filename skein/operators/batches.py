"""Arrow-batch steps of the indexes: nearest centroid and product codes by matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(df: DataFrame, *more: T.StructField) -> T.StructType:
    names = {f.name for f in more}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *more])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)


def _with(b: pa.RecordBatch, **cols) -> pa.RecordBatch:
    keep = [c for c in b.schema.names if c not in cols]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols.values()], names=[*keep, *cols])


def add_nearest(docs: DataFrame, points: np.ndarray, metric: str, distance: str | None = None) -> DataFrame:
    """`docs` with ``cell``, the nearest of a bounded number of points, and optionally its distance."""
    fields = [T.StructField("cell", T.IntegerType())] + ([T.StructField(distance, T.DoubleType())] if distance else [])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b)
            if metric == "dot":
                d = -(x @ points.T)
            elif metric == "cosine":
                n = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((points * points).sum(axis=1))[None, :]
                d = 1 - np.where(n > 0, x @ points.T / np.where(n > 0, n, 1), 0)
            else:
                d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
            at = d.argmin(axis=1)
            more = {"cell": pa.array(at.astype(np.int32))}
            if distance:
                more[distance] = pa.array(np.sqrt(((x - points[at]) ** 2).sum(axis=1)))
            yield _with(b, **more)

    return docs.mapInArrow(run, _schema(docs, *fields))


def add_codes(docs: DataFrame, books: np.ndarray) -> DataFrame:
    """`docs` with ``codes``, the nearest codebook entry of each subspace."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b).reshape(b.num_rows, len(books), -1)
                c = np.stack([((x[:, j, None, :] - books[j][None]) ** 2).sum(axis=2).argmin(axis=1) for j in range(len(books))], axis=1)
                yield _with(b, codes=pa.array(c.astype(np.int32).tolist(), pa.list_(pa.int32())))

    return docs.mapInArrow(run, _schema(docs, T.StructField("codes", T.ArrayType(T.IntegerType()))))


def kmeans_plusplus(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Centroids by D² seeding and Lloyd's steps, and their inertia."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    d = ((x - c[0]) ** 2).sum(axis=1)
    while len(c) < k:
        i = rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))
        c.append(x[i])
        d = np.minimum(d, ((x - x[i]) ** 2).sum(axis=1))
    c = np.stack(c)
    own = (x * x).sum(axis=1)
    for _ in range(rounds):
        dist = own[:, None] + (c * c).sum(axis=1)[None] - 2 * x @ c.T
        at = dist.argmin(axis=1)
        order, n = np.argsort(at, kind="stable"), np.bincount(at, minlength=k)
        has, new = n > 0, c.copy()
        new[has] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n)[:-1]])[has], axis=0) / n[has, None]
        if np.allclose(new, c):
            break
        c = new
    return c, float(np.maximum(0, dist.min(axis=1)).sum())
