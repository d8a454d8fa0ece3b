"""Exact nearest-neighbour search: single queries, batches, thresholds, filters, reranking.

Single queries are declarative (one scan, `TakeOrderedAndProject`). Batches
score blocks of records against blocks of queries by matrix products; each
task keeps only its best `k` a query, which the next block has to surpass, so little more than ``k`` rows a query and
task are shuffled.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.errors import DimensionMismatch, InvalidVector
from skein.functions import vectors as V
from skein.operators.filters import compile_filter

MAX_K = 10_000
#: Queries shipped at once: at 1536 dimensions at most 50 MB.
QUERY_BLOCK = 4096
#: Cells of records by queries that a task holds at once.
CELLS = 1 << 22


def clamp_k(k: int | None) -> int:
    """Default 10, from 1 to 10000."""
    return 10 if k is None else max(1, min(MAX_K, k))


def literal(q) -> F.Column:
    if not len(q) or not np.isfinite(np.asarray(q, dtype=float)).all():
        raise InvalidVector("a query must not be empty and must be finite")
    return F.array(*[F.lit(float(x)) for x in q])


def topk(docs: DataFrame, query, k: int = 10, kind: str = "cosine", where=None) -> DataFrame:
    """``docs`` columns without the vector, with ``score``; vectors of other lengths are skipped.

    Ties go to the smaller id. `where` is a tag filter applied before ranking.
    """
    if where is not None:
        docs = docs.filter(compile_filter(where))
    scored = docs.filter(F.size("vector") == len(query)).withColumn("score", V.score("vector", literal(query), kind))
    return scored.drop("vector").orderBy(F.desc("score"), "id").limit(k)


def index_topk(docs: DataFrame, query, k: int = 10, metric: str = "euclidean", index: str = "hnsw", ef: int | None = None, dimension: int | None = None, where=None, postfilter: bool = False) -> DataFrame:
    """Search with the distance and score of an index kind: ``id, ..., distance, score``.

    The plan is exact, so `ef` is accepted and has no effect. With `postfilter`
    the best ``max(10 k, 100)`` are taken before filtering, so fewer than `k` may be
    left, as stores do that filter what an index returns.
    """
    if dimension is not None and len(query) != dimension:
        raise DimensionMismatch(dimension, len(query))
    del ef
    if where is not None and not postfilter:
        docs = docs.filter(compile_filter(where))
    d = docs.filter(F.size("vector") == len(query)).withColumn("distance", V.index_distance("vector", literal(query), metric, index))
    d = d.withColumn("score", V.index_score(F.col("distance"), metric, index)).drop("vector")
    if where is not None and postfilter:
        return d.orderBy("distance", "id").limit(max(10 * k, 100)).filter(compile_filter(where)).orderBy("distance", "id").limit(k)
    return d.orderBy("distance", "id").limit(k)


def threshold(docs: DataFrame, query, least: float, most: int = 100, kind: str = "cosine", where=None) -> DataFrame:
    """At most `most` records of score `least` or more, the best first."""
    return topk(docs, query, most, kind, where).filter(F.col("score") >= least)


def _scores(x: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    if kind == "manhattan":
        return np.stack([1 / (1 + np.abs(x - v).sum(axis=1)) for v in q], axis=1)
    s = x @ q.T
    if kind == "dot":
        return s
    if kind == "cosine":
        n = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None, :]
        return np.where(n == 0, 0.0, s / np.where(n == 0, 1, n))
    d = np.maximum(0, (x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * s)
    return 1 / (1 + np.sqrt(d))


def batch_topk(docs: DataFrame, queries: DataFrame, k: int = 10, kind: str = "cosine", digits: int | None = None) -> DataFrame:
    """``(query_id, id, score, rank)`` for ``queries(query_id, vector)`` over ``docs(id, vector)``.

    Null vectors and those of another length than a query are skipped. Queries
    go out in blocks of `QUERY_BLOCK`; every block is one pass over `docs`. With
    `digits` scores that are equal to so many digits are ties.
    """
    if kind not in ("cosine", "euclidean", "manhattan", "dot"):
        raise ValueError(f"unknown similarity {kind!r}")
    ids = dict(docs.dtypes)["id"]
    qid = dict(queries.dtypes)["query_id"]
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    parts = []
    for n in range(blocks):
        block = queries.select("query_id", "vector").filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toPandas().dropna()
        parts.append(docs.select("id", "vector").mapInArrow(_pass(block, k, kind, digits, to_arrow_type(queries.schema["query_id"].dataType)), f"query_id {qid}, id {ids}, score double, place double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), "id")
    merged = functools.reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best))
    return merged.filter(F.col("rank") <= k).drop("place")


def plain(ids: pa.Array) -> np.ndarray:
    """Ids that numpy can order."""
    return ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.array(ids.to_pylist(), dtype=object)


def best_of(parts: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """The best `k` of each query of ``(query, place, id, score)``, in this order, ties to the smaller id."""
    query, place, ids, score = (np.concatenate(z) for z in zip(*parts))
    by = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
    order = np.lexsort((by, -place, query))
    n = query[order]
    first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, np.int64)
    order = order[np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n)))) < k]
    return query[order], place[order], ids[order], score[order]


class Best:
    """The best `k` of each of `total` queries so far; `least` is the place from which a pair can still be one of them."""

    def __init__(self, total: int, k: int):
        self.total, self.k, self.parts, self.more, self.least = total, k, [], 0, np.full(total, -np.inf)

    def add(self, query: np.ndarray, place: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, place, ids, score))
        self.more += len(query)
        if self.more > self.total * self.k:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        self.parts, self.more = [best_of(self.parts, self.k)], 0
        query, place = self.parts[0][:2]
        n = np.bincount(query, minlength=self.total)
        full = np.flatnonzero(n >= self.k)
        self.least[full] = place[n.cumsum()[full] - 1]
        return self.parts[0]


def _pass(block, k: int, kind: str, digits: int | None, q_type: pa.DataType):
    size = block["vector"].map(len) if len(block) else []
    groups = {int(d): (block["query_id"][size == d].tolist(), np.stack(block["vector"][size == d].to_numpy()).astype(np.float64)) for d in sorted(set(size))}

    def run(batches):
        held = {d: Best(len(q), k) for d, (_, q) in groups.items()}
        ids_type = None
        for b in batches:
            ids_type = b.schema.field("id").type
            lists = b.column("vector")
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = plain(b.column("id"))
            for d, (_, q) in groups.items():
                every, step, best = np.nonzero(length == d)[0], max(1, CELLS // len(q)), held[d]
                for i in range(0, len(every), step):
                    own = every[i : i + step]
                    x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d).astype(np.float64)
                    s = _scores(x, q, kind)
                    s = np.where(np.isnan(s), -np.inf, s).T
                    place = s if digits is None else np.floor(s * 10**digits + 0.5)
                    edge = best.least[:, None]
                    if np.isneginf(edge).any() and place.shape[1] > k:  # nothing to compare with: the best k of these
                        edge = np.maximum(edge, np.partition(place, -k, axis=1)[:, -k][:, None])
                    at, col = np.nonzero((place >= edge) & (s > -np.inf))
                    best.add(at, place[at, col], ids[own[col]], s[at, col])
        for d, best in held.items():
            if best.parts:
                at, place, who, score = best.merge()
                names = groups[d][0]
                yield pa.RecordBatch.from_arrays([pa.array([names[a] for a in at], q_type), pa.array(who.tolist(), ids_type), pa.array(score), pa.array(place)], names=["query_id", "id", "score", "place"])

    return run


def rerank(docs: DataFrame, candidates: DataFrame, query, k: int = 10, metric: str = "euclidean") -> DataFrame:
    """Candidates ``(id)`` of a cheap stage scored exactly; copies of an id count once."""
    return index_topk(docs.join(candidates.select("id").distinct(), "id", "left_semi"), query, k, metric, "exact")
