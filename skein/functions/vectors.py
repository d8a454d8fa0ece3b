"""Vector scalar functions as Column expressions; all arithmetic in double precision.

Two vectors of different lengths give null, as does a null vector. A zero norm
gives cosine 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fold(a, b, f) -> Column:
    a, b = _c(a), _c(b)
    z = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(z, F.lit(0.0), lambda s, x: s + x))


def dot(a, b) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2(a, b) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a, b) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def pearson(a, b) -> Column:
    """Correlation of two vectors, 0 if one is constant."""
    a, b = _c(a), _c(b)
    n = F.size(a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    ma, mb = total(a) / n, total(b) / n
    da = F.transform(a, lambda x: x.cast("double") - ma)
    db = F.transform(b, lambda x: x.cast("double") - mb)
    return cosine(da, db)


def score(a, b, kind: str) -> Column:
    """cosine, euclidean 1 / (1 + d), manhattan 1 / (1 + d), or dot."""
    if kind == "cosine":
        return cosine(a, b)
    if kind == "euclidean":
        return 1 / (1 + l2(a, b))
    if kind == "manhattan":
        return 1 / (1 + l1(a, b))
    if kind == "dot":
        return dot(a, b)
    raise ValueError(f"unknown similarity {kind!r}")


def index_score(distance: Column, metric: str, index: str) -> Column:
    """Score of an index from its distance: the formula depends on the index as well as the metric."""
    if metric == "dot" and index in ("hnsw", "ivf", "sq8", "exact"):
        return -distance
    if index == "lsh" or (metric == "cosine" and index in ("hnsw", "exact")):
        return 1 - distance
    return 1 / (1 + distance)


def index_distance(a, b, metric: str, index: str) -> Column:
    if index in ("es4d", "pq"):
        metric = "euclidean"
    if index == "lsh":
        metric = "cosine"
    return {"euclidean": lambda: l2(a, b), "cosine": lambda: 1 - cosine(a, b), "dot": lambda: -dot(a, b)}[metric]()


def is_valid(v) -> Column:
    """Not empty and all values finite."""
    v = _c(v)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def normalize(v) -> Column:
    """Scaled to length 1; an invalid or zero vector raises when evaluated."""
    v = _c(v)
    n = norm(v)
    return F.when(~is_valid(v), F.raise_error(F.lit("InvalidVector"))).when(n == 0, F.raise_error(F.lit("InvalidVector: zero norm"))).otherwise(F.transform(v, lambda x: x / n))


def zeros(dimension: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dimension)


def reorder(v, order: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i + 1) for i in order]), lambda i: F.element_at(_c(v), i))


def hamming(a, b) -> Column:
    """Differing bits of two BIGINT signatures."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))
