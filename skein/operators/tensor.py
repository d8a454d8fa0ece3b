"""Tensors as flat row-major data with a shape: access, similarity, template search by shifting."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.errors import DimensionMismatch, InvalidVector, VectorNotFound
from skein.functions import vectors as V
from skein.operators.search import literal
from skein.sources.versions import VersionedTable

class TensorStore:
    """Tensors ``(id, data, shape)`` at a path; inserting a known id replaces it."""

    def __init__(self, spark, path: str):
        self.table = VersionedTable(spark, path, "id string, data array<double>, shape array<int>")

    def read(self) -> DataFrame:
        return self.table.read()

    def insert(self, rows: DataFrame) -> None:
        """Add or replace; an invalid tensor raises before anything is written. Of repeated ids the greatest data count."""
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("data").cast("array<double>").alias("data"), F.col("shape").cast("array<int>").alias("shape"))
        if bad := rows.filter(~is_valid()).select("id").limit(1).collect():
            raise InvalidVector(f"tensor {bad[0]['id']}")
        self.table.append(rows.groupBy("id").agg(F.max(F.struct("data", "shape")).alias("r")).select("id", "r.data", "r.shape"))

    def get(self, id_: str) -> DataFrame:
        rows = self.table.read(where=F.col("id") == id_)
        if not rows.limit(1).count():
            raise VectorNotFound(id_)
        return rows

    def delete(self, ids: DataFrame) -> None:
        ids = ids.select(F.col("id").cast("string").alias("id")).distinct()
        if missing := ids.join(self.read().select("id"), "id", "left_anti").limit(1).collect():
            raise VectorNotFound(missing[0]["id"])
        self.table.append(self.read().limit(0), gone=ids)

    def list_ids(self) -> DataFrame:
        return self.read().select("id").orderBy("id")

    def __len__(self) -> int:
        return self.read().count()


SIMILARITY = {"dot": V.dot, "cosine": V.cosine, "pearson": V.pearson}


def strides(shape: list[int]) -> list[int]:
    return [prod(shape[i + 1 :]) for i in range(len(shape))]


def is_valid(data: str = "data", shape: str = "shape") -> Column:
    """Rank of at least 1 and as many values as the shape says."""
    n = F.aggregate(F.col(shape), F.lit(1), lambda s, x: s * x)
    return F.coalesce((F.size(shape) >= 1) & (n == F.size(data)), F.lit(False))


def get(index: list[int], data: str = "data", shape: str = "shape") -> Column:
    """The value at an index, null outside."""
    flat = F.lit(0)
    inside = F.lit(True)
    for i, x in enumerate(index):
        size = F.element_at(F.col(shape), i + 1)
        flat = flat * size + x
        inside = inside & (F.lit(x) < size) & F.lit(x >= 0)
    return F.when(inside & (F.size(shape) == len(index)), F.try_element_at(F.col(data), flat + 1))


def gather(places: list[int], data: str = "data") -> Column:
    """Values at flat places; a contiguous run is a slice."""
    if places and places == list(range(places[0], places[0] + len(places))):
        return F.slice(F.col(data), places[0] + 1, len(places))
    return F.transform(F.array(*[F.lit(p + 1) for p in places]), lambda p: F.element_at(F.col(data), p))


def _places(shape: list[int], ranges: list[range]) -> list[int]:
    out = [0]
    for r, s in zip(ranges, strides(shape)):
        out = [o + x * s for o in out for x in r]
    return out


def subtensor(shape: list[int], dim: int, start: int, length: int, data: str = "data") -> Column:
    """The data of the part ``[start, start + length)`` along `dim` for tensors of a known shape."""
    if not 0 <= dim < len(shape) or start < 0 or start + length > shape[dim]:
        raise DimensionMismatch(shape, (dim, start, length))
    return gather(_places(shape, [range(start, start + length) if i == dim else range(n) for i, n in enumerate(shape)]), data)


def fiber(shape: list[int], dim: int, fixed: list[int], data: str = "data") -> Column:
    """The line along `dim` at fixed places of the others."""
    return gather(_places(shape, [range(n) if i == dim else range(fixed[i], fixed[i] + 1) for i, n in enumerate(shape)]), data)


def row(columns: int, r: int, data: str = "data") -> Column:
    return F.slice(F.col(data), r * columns + 1, columns)


def _weighted(parts: list[tuple[Column, Column]], weights: list[float] | None, kind: str) -> Column:
    w = weights or [1.0] * len(parts)
    if len(w) != len(parts):
        raise DimensionMismatch(len(parts), len(w))
    if sum(w) <= 0:
        return F.lit(0.0)
    total = F.lit(0.0)
    for x, (a, b) in zip(w, parts):
        total = total + x * SIMILARITY[kind](a, b)
    return total / sum(w)


def search(tensors: DataFrame, query: list[float], shape: list[int], k: int = 10, kind: str = "cosine", agg_dim: int | None = None, weights: list[float] | None = None) -> DataFrame:
    """Tensors of the query's shape by similarity: ``id, score``.

    With `agg_dim` the similarity is the weighted mean over slices: for two
    dimensions and ``agg_dim=1`` over rows, for others over the slices along `agg_dim`.
    """
    if prod(shape) != len(query):
        raise DimensionMismatch(prod(shape), len(query))
    same = tensors.filter(is_valid() & (F.col("shape") == F.array(*[F.lit(int(s)) for s in shape])))
    q = literal(query)
    if agg_dim is None:
        s = SIMILARITY[kind](F.col("data"), q)
    else:
        d = 0 if len(shape) == 2 and agg_dim == 1 else agg_dim
        take = lambda i: _places(shape, [range(i, i + 1) if j == d else range(n) for j, n in enumerate(shape)])
        s = _weighted([(gather(take(i)), literal([query[p] for p in take(i)])) for i in range(shape[d])], weights, kind)
    return same.select("id", s.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def shifting_search(tensors: DataFrame, pattern: list[float], shape: list[int], k: int = 10, kind: str = "dot", shift_dim: int = 0, agg_dim: int | None = None, weights: list[float] | None = None) -> DataFrame:
    """The pattern slid along `shift_dim` of each tensor: the best `k` ``id, offset, score``.

    Tensors of other sizes in other dimensions, or shorter than the pattern
    along `shift_dim`, are skipped. For two dimensions with shift 0 and
    ``agg_dim=1`` the weighted mean is over columns.
    """
    if not 0 <= shift_dim < len(shape) or prod(shape) != len(pattern):
        raise DimensionMismatch(shape, shift_dim)
    fit = is_valid() & (F.size("shape") == len(shape)) & (F.element_at("shape", shift_dim + 1) >= shape[shift_dim])
    for i, n in enumerate(shape):
        if i != shift_dim:
            fit = fit & (F.try_element_at("shape", F.lit(i + 1)) == n)
    t = tensors.filter(fit).withColumn("offset", F.explode(F.sequence(F.lit(0), F.element_at("shape", shift_dim + 1) - shape[shift_dim])))
    inner = prod(shape[shift_dim + 1 :])
    outer = prod(shape[:shift_dim])
    long = F.element_at("shape", shift_dim + 1)
    if outer == 1:
        t = t.withColumn("part", F.slice("data", F.col("offset") * inner + 1, len(pattern)))
    else:
        block = shape[shift_dim] * inner
        at = F.transform(F.sequence(F.lit(0), F.lit(len(pattern) - 1)), lambda p: F.floor(p / block) * long * inner + F.col("offset") * inner + p % block)
        t = t.withColumn("part", F.transform(at, lambda p: F.element_at(F.col("data"), p.cast("int") + 1)))
    if agg_dim is None:
        s = SIMILARITY[kind](F.col("part"), literal(pattern))
    else:
        take = lambda i: _places(shape, [range(i, i + 1) if j == agg_dim else range(n) for j, n in enumerate(shape)])
        s = _weighted([(gather(take(i), "part"), literal([pattern[p] for p in take(i)])) for i in range(shape[agg_dim])], weights, kind)
    return t.select("id", "offset", s.alias("score")).orderBy(F.desc("score"), "id", "offset").limit(k)
