"""Fusion of a dense and a sparse ranking, both ``(id, score[, matched_terms])`` for one query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Candidates of a single ranking that are fused.
MOST = 100_000
#: Scores that are equal to so many digits are ties.
DIGITS = 9


@dataclass(frozen=True)
class WeightedSum:
    dense: float = 0.7
    sparse: float = 0.3


@dataclass(frozen=True)
class Rrf:
    k: float = 60.0


def parse(name: str | None, dense: float = 0.7, sparse: float = 0.3, k: float = 60.0):
    if name in (None, "rrf"):
        return Rrf(k)
    if name == "weighted":
        return WeightedSum(dense, sparse)
    raise ValueError(f"unknown fusion {name!r}")


def best(*by: str):
    """The window of the best scores first, ties (to nine digits) to the smaller id."""
    return Window.partitionBy(*by).orderBy(F.desc(F.round("score", DIGITS)), "id")


def fuse(dense: DataFrame, sparse: DataFrame, method=None, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """``(id, dense_score, sparse_score, combined_score, matched_terms)``, the best `k`.

    The score of a missing side is 0. `by` names columns that tell queries
    apart; then the best `k` of each are given. Without it both sides are one
    ranking, of which the best `MOST` count, so no task ranks more than that.
    """
    by = by or []
    method = method or Rrf()
    if not by:
        dense, sparse = (d.orderBy(F.desc("score"), "id").limit(MOST) for d in (dense, sparse))
    rank = lambda d: d.withColumn("rn", F.row_number().over(best(*by)))
    if "matched_terms" not in sparse.columns:
        sparse = sparse.withColumn("matched_terms", F.array().cast("array<string>"))
    if isinstance(method, Rrf):
        dense, sparse = rank(dense), rank(sparse)
    else:
        dense, sparse = dense.withColumn("rn", F.lit(0)), sparse.withColumn("rn", F.lit(0))
    d = dense.select(*by, "id", F.col("score").alias("ds"), F.col("rn").alias("dr"))
    s = sparse.select(*by, "id", F.col("score").alias("ss"), F.col("rn").alias("sr"), "matched_terms")
    both = d.join(s, [*by, "id"], "full")
    zero = F.lit(0.0)
    if isinstance(method, Rrf):
        total = F.coalesce(1 / (method.k + F.col("dr")), zero) + F.coalesce(1 / (method.k + F.col("sr")), zero)
    else:
        total = method.dense * F.coalesce("ds", zero) + method.sparse * F.coalesce("ss", zero)
    out = both.select(*by, "id", F.coalesce("ds", zero).alias("dense_score"), F.coalesce("ss", zero).alias("sparse_score"), total.alias("combined_score"), F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"))
    if not by:
        return out.orderBy(F.desc("combined_score"), "id").limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("combined_score", 9)), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
