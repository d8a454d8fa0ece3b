"""A navigable graph over vectors, in shards: build, and beam search with `ef`.

Every shard is a graph of its own, built where its rows are: each record is
linked with its `links` nearest ones in the shard, links go both ways and only
the ``2 links`` nearest of a record stay, and two random links a record hold
distant parts together. A search starts from a few spread records of every
shard and keeps the best `ef` it has seen; shards work side by side and their
best are merged. Records that have been removed are holes that a walk steps over.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records a shard, and starts of a walk.
SHARD, STARTS = 8192, 16


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to one query: Euclidean, 1 - cosine, or the negative inner product."""
    if metric == "euclidean":
        return np.sqrt(np.maximum(0, ((x - q) ** 2).sum(axis=1)))
    s = x @ q
    if metric == "dot":
        return -s
    n = np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q)
    return 1 - np.where(n > 0, s / np.where(n > 0, n, 1), 0)


def link(x: np.ndarray, links: int, metric: str, seed: int = 42) -> list[np.ndarray]:
    """The neighbours of each row."""
    n = len(x)
    y = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30) if metric == "cosine" else x
    half = 0.5 * (y * y).sum(axis=1) if metric == "euclidean" else np.zeros(n)
    k = min(links, n - 1)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i in range(0, n if k > 0 else 0, 512):
        s = y[i : i + 512] @ y.T - half  # the greater the nearer
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        for r, row in enumerate(np.argpartition(-s, k - 1, axis=1)[:, :k]):
            for j in row:
                d = float(half[i + r] - s[r, j])
                near[i + r][int(j)] = near[int(j)][i + r] = d
    rng = np.random.default_rng(seed)
    far = rng.integers(0, n, (n, 2)) if n else np.zeros((0, 2), int)
    return [np.unique(np.array([*heapq.nsmallest(2 * links, m, key=m.get), *far[i]], np.int32)) for i, m in enumerate(near)]


def walk(x: np.ndarray, near: list, q: np.ndarray, ef: int, metric: str) -> list[tuple[float, int]]:
    """The best `ef` records found from the starts, nearest first."""
    start = np.unique(np.linspace(0, len(x) - 1, min(len(x), STARTS)).astype(int))
    seen = np.zeros(len(x), bool)
    seen[start] = True
    todo = [(float(d), int(i)) for d, i in zip(distances(x[start], q, metric), start)]
    best = [(-d, -i) for d, i in todo]
    heapq.heapify(todo)
    heapq.heapify(best)
    while len(best) > ef:
        heapq.heappop(best)
    while todo:
        d, i = heapq.heappop(todo)
        if len(best) >= ef and d > -best[0][0]:
            break
        new = near[i][~seen[near[i]]]
        seen[new] = True
        for e, j in zip(distances(x[new], q, metric).tolist() if len(new) else (), new.tolist()):
            if len(best) < ef or e < -best[0][0]:
                heapq.heappush(todo, (e, j))
                heapq.heappush(best, (-e, -j))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted((-d, -i) for d, i in best)


def build(docs: DataFrame, n: int, links: int = 16, metric: str = "euclidean", first: int = 0, shard: int = SHARD) -> DataFrame:
    """``(cell, id, vector, node, codes)`` from ``(id, vector)``: the shard, the number in it and the neighbours' numbers.

    Shards are numbered from `first`; `n` is the number of records.
    """
    shards = max(1, -(-n // shard))
    rows = docs.select("id", "vector", (F.pmod(F.xxhash64("id"), F.lit(shards)) + first).cast("int").alias("cell"))

    def run(table):
        table = table.sort_by("id")
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(np.float64)
        near = link(x, links, metric)
        return pa.table([table.column("cell"), table.column("id"), table.column("vector"), pa.array(np.arange(len(x), dtype=np.int32)), pa.array([v.tolist() for v in near], pa.list_(pa.int32()))], names=["cell", "id", "vector", "node", "codes"])

    return rows.groupBy("cell").applyInArrow(run, "cell int, id string, vector array<float>, node int, codes array<int>")


def search(graph: DataFrame, queries: list[tuple[str, list[float]]], k: int, ef: int, metric: str = "euclidean") -> DataFrame:
    """``(query_id, id, distance, rank)``: the best `k` of the `ef` that each walk keeps. Queries are shipped."""
    ef = max(ef, k)

    def run(table):
        node = table.column("node").to_numpy()
        at = np.full(int(node.max()) + 1, -1, np.int64)
        at[node] = np.arange(len(node))
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(np.float64)
        near = []
        for v in table.column("codes").to_pylist():
            v = np.array(v, np.int64)
            v = at[v[v < len(at)]]
            near.append(v[v >= 0])
        ids = table.column("id")
        out = [(name, i, d) for name, q in queries for d, i in walk(x, near, np.asarray(q, float), ef, metric)[:k]]
        return pa.table([pa.array([o[0] for o in out], pa.string()), ids.take(pa.array([o[1] for o in out], pa.int64())), pa.array([o[2] for o in out], pa.float64())], names=["query_id", "id", "distance"])

    found = graph.groupBy("cell").applyInArrow(run, "query_id string, id string, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
