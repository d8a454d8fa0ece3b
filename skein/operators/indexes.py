"""Indexes as explicit artefacts: trained from a DataFrame, encoded into one, searched as plans.

Parameters (centroids, codebooks, ranges, planes) are small and bounded by the
configuration; encoded collections are DataFrames that can be written with
`partitionBy` so that probing prunes files.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.errors import DimensionMismatch
from skein.functions import vectors as V
from skein.operators.search import index_topk, literal

#: Rows of a training sample for codebooks, the first in hash order of the id.
SAMPLE = 20_000


def _sample(docs: DataFrame, n: int = SAMPLE) -> np.ndarray:
    rows, total = docs.select("vector", F.xxhash64("id").alias("h"), "id"), docs.count()
    # Rows well beyond the place in hash order do not go to the driver.
    share = (n + 6 * n**0.5 + 16) / max(1, total)
    if share < 1:
        rows = rows.filter(F.col("h") <= int(-(2**63) + share * 2**64))
    rows = rows.orderBy("h", "id").limit(n).select("vector").toPandas()
    return np.stack(rows["vector"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0))


def per_dimension(docs: DataFrame) -> DataFrame:
    """``(pos, lo, hi, variance)`` of each dimension, combined within tasks before the shuffle."""
    x = docs.select(F.posexplode("vector").alias("pos", "x"))
    return x.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop(F.col("x").cast("double")).alias("variance"))


def variance_order(docs: DataFrame) -> list[int]:
    """Dimensions by falling variance, ties to the smaller."""
    return [r["pos"] for r in per_dimension(docs).orderBy(F.desc("variance"), "pos").collect()]


@dataclass
class Centroids:
    """k-means centroids; ``assign`` gives the nearest, ties to the smaller number."""

    points: list[list[float]]
    metric: str = "euclidean"

    @classmethod
    def train(cls, docs: DataFrame, k: int, metric: str = "euclidean", rounds: int = 25, seed: int = 42) -> Centroids:
        """k-means++ and Lloyd's steps on a sample of `SAMPLE` records, the first in hash order."""
        from skein.operators.batches import kmeans_plusplus

        x = _sample(docs)
        return cls(kmeans_plusplus(x, min(k, len(x)), rounds, seed)[0].tolist() if len(x) else [], metric)

    def assign(self, docs: DataFrame) -> DataFrame:
        """`docs` with ``cell`` by matrix products in Arrow batches."""
        from skein.operators.batches import add_nearest

        return add_nearest(docs, np.asarray(self.points), self.metric)

    def nearest(self, query, n: int) -> list[int]:
        q, c = np.asarray(query, float), np.asarray(self.points)
        if self.metric == "euclidean":
            d = ((c - q) ** 2).sum(axis=1)
        elif self.metric == "dot":
            d = -(c @ q)
        else:
            norms = np.sqrt((c * c).sum(axis=1)) * np.sqrt(q @ q)
            d = 1 - np.where(norms > 0, c @ q / np.where(norms > 0, norms, 1), 0)
        return np.argsort(d, kind="stable")[:n].tolist()


@dataclass
class Ivf:
    """Inverted lists: exact search within the `nprobe` cells nearest to the query."""

    centroids: Centroids
    lists: DataFrame
    metric: str = "euclidean"

    @classmethod
    def train(cls, docs: DataFrame, nlist: int = 256, metric: str = "euclidean", seed: int = 42) -> Ivf:
        c = Centroids.train(docs, nlist, "euclidean", 25, seed)
        c.metric = metric
        return cls(c, c.assign(docs), metric)

    def search(self, query, k: int = 10, nprobe: int = 16) -> DataFrame:
        if self.centroids.points and len(query) != len(self.centroids.points[0]):
            raise DimensionMismatch(len(self.centroids.points[0]), len(query))
        cells = self.centroids.nearest(query, nprobe) if self.centroids.points else []
        return index_topk(self.lists.filter(F.col("cell").isin(*cells) if cells else F.lit(False)).drop("cell"), query, k, self.metric, "ivf")


@dataclass
class Sq8:
    """Scalar quantisation to a byte a dimension: truncated, clamped to 0..255."""

    lo: list[float]
    scale: list[float]

    @classmethod
    def train(cls, docs: DataFrame) -> Sq8:
        rows = per_dimension(docs).orderBy("pos").collect()
        return cls([float(r["lo"]) for r in rows], [((float(r["hi"]) - float(r["lo"])) / 255) or 1.0 for r in rows])

    def encode(self, v) -> F.Column:
        above = F.zip_with(F.col(v) if isinstance(v, str) else v, literal(self.lo), lambda x, m: x.cast("double") - m)
        return F.zip_with(above, literal(self.scale), lambda x, s: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x / s)).cast("int"))

    def decode(self, codes) -> F.Column:
        c = F.col(codes) if isinstance(codes, str) else codes
        return F.zip_with(F.zip_with(c, literal(self.scale), lambda x, s: x * s), literal(self.lo), lambda x, m: x + m)

    def search(self, coded: DataFrame, query, k: int = 10, metric: str = "euclidean") -> DataFrame:
        """Scan of ``(id, codes)``."""
        return index_topk(coded.withColumn("vector", self.decode("codes")).drop("codes"), query, k, metric, "sq8")


@dataclass
class Pq:
    """Product quantisation with `m` subspaces; search by asymmetric tables."""

    books: np.ndarray

    @classmethod
    def train(cls, docs: DataFrame, m: int = 8, codes: int = 256, restarts: int = 3, rounds: int = 50, seed: int = 42) -> Pq:
        x = _sample(docs)
        if not len(x):
            return cls(np.zeros((m, 0, 0)))
        if x.shape[1] % m:
            raise DimensionMismatch(f"a multiple of {m}", x.shape[1])
        from skein.operators.batches import kmeans_plusplus

        w = x.shape[1] // m
        return cls(np.stack([min((kmeans_plusplus(x[:, j * w : (j + 1) * w], min(codes, len(x)), rounds, seed + r) for r in range(restarts)), key=lambda t: t[1])[0] for j in range(m)]))

    def encode(self, docs: DataFrame) -> DataFrame:
        from skein.operators.batches import add_codes

        return add_codes(docs, self.books)

    def decode(self, codes: list[int]) -> list[float]:
        return np.concatenate([self.books[j][c] for j, c in enumerate(codes)]).tolist()

    def search(self, coded: DataFrame, query, k: int = 10) -> DataFrame:
        """``distance = sqrt(sum of table values)`` over ``(id, codes)``; always Euclidean."""
        m, n, w = self.books.shape
        if m * w and len(query) != m * w:
            raise DimensionMismatch(m * w, len(query))
        q = np.asarray(query, float).reshape(m, w) if w else np.zeros((m, 0))
        tables = ((self.books - q[:, None, :]) ** 2).sum(axis=2)
        lut = F.array(*[literal(t) for t in tables]) if n else F.array()
        parts = F.transform(F.col("codes"), lambda c, i: F.element_at(F.element_at(lut, i + 1), c + 1))
        d = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))
        return coded.withColumn("distance", d).withColumn("score", 1 / (1 + F.col("distance"))).drop("codes", "vector").orderBy("distance", "id").limit(k)


@dataclass
class Lsh:
    """Random hyperplanes: bit i of the signature is ``v . h_i > t_i``."""

    planes: np.ndarray
    offsets: np.ndarray

    @classmethod
    def make(cls, dimension: int, hashes: int = 10, seed: int = 42) -> Lsh:
        rng = np.random.default_rng(seed)
        return cls(rng.uniform(-1, 1, (hashes, dimension)), rng.uniform(-1, 1, hashes))

    def signature(self, v: str = "vector") -> F.Column:
        bits = [F.when(V.dot(F.col(v), literal(p)) > float(t), F.lit(1 << i)).otherwise(F.lit(0)) for i, (p, t) in enumerate(zip(self.planes, self.offsets))]
        return sum(bits[1:], bits[0]).cast("bigint")

    def of(self, query) -> int:
        """The signature of a query."""
        return sum(1 << i for i in range(len(self.planes)) if float(self.planes[i] @ np.asarray(query, float)) > self.offsets[i])

    def search(self, signed: DataFrame, query, k: int = 10) -> DataFrame:
        """Records of a signature within one bit of the query's; all records if these are fewer than `k`."""
        s = self.of(query)
        near = signed.filter(V.hamming(F.col("sig"), F.lit(s).cast("bigint")) <= 1)
        if near.limit(k).count() < k:
            near = signed
        return index_topk(near.drop("sig"), query, k, "cosine", "lsh")


@dataclass
class HashBuckets:
    """Several weighted-sign hashes: bit ``i mod 64`` of a key is set where ``v[i] w[i] > 0``.

    Buckets are exact matches of a key, so vectors of up to 64 values meet only
    if all their signs agree, under one function as under any other: the index
    finds near copies, not the k most similar.
    """

    weights: np.ndarray

    @classmethod
    def make(cls, dimension: int, functions: int = 4, seed: int = 42) -> HashBuckets:
        return cls(np.random.default_rng(seed).uniform(-1, 1, (functions, dimension)))

    def keys(self, v: str = "vector") -> F.Column:
        out = []
        for f, w in enumerate(self.weights):
            signs = f"transform(zip_with({v}, array({', '.join(f'{float(x)!r}D' for x in w)}), (x, w) -> x * w), (p, i) -> if(p > 0, shiftleft(1L, i % 64), 0L))"
            out.append(F.struct(F.lit(f).alias("f"), F.expr(f"aggregate({signs}, 0L, (a, b) -> a | b)").alias("key")))
        return F.array(*out)

    def query_keys(self, q) -> list[tuple[int, int]]:
        out = []
        for f, w in enumerate(self.weights):
            key = 0
            for i, x in enumerate(q):
                key |= (1 << (i % 64)) if x * w[i] > 0 else 0
            out.append((f, key - (1 << 64) if key >= 1 << 63 else key))
        return out

    def search(self, docs: DataFrame, query, k: int = 10) -> DataFrame:
        from skein.operators.search import topk

        want = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(x).cast("bigint").alias("key")) for f, x in self.query_keys(query)])
        hit = F.arrays_overlap(self.keys(), want)
        return topk(docs.filter(hit), query, k, "cosine")


@dataclass
class Es4d:
    """Exact Euclidean search that skips clusters by the triangle inequality.

    Clusters have a centroid and a radius; a cluster is scanned only if its
    nearest possible member beats the k-th best distance found in the cluster
    nearest to the query. Dimensions are ordered by falling variance, so that
    partial sums of squares pass the cutoff early.
    """

    order: list[int]
    centroids: Centroids
    members: DataFrame
    stats: list[tuple[int, float, int]]

    @classmethod
    def train(cls, docs: DataFrame, seed: int = 42) -> Es4d:
        n = docs.count()
        order = variance_order(docs)
        ordered = docs.withColumn("vector", V.reorder("vector", order)) if order else docs
        c = Centroids.train(ordered, max(1, int(n**0.5)), "euclidean", 20, seed)
        from skein.operators.batches import add_nearest

        members = add_nearest(ordered, np.asarray(c.points), "euclidean", distance="d_center") if c.points else ordered.withColumn("cell", F.lit(0)).withColumn("d_center", F.lit(0.0))
        stats = [(r["cell"], r["radius"], r["n"]) for r in members.groupBy("cell").agg(F.max("d_center").alias("radius"), F.count("*").alias("n")).collect()]
        return cls(order, c, members, stats)

    def search(self, query, k: int = 10) -> DataFrame:
        if self.order and len(query) != len(self.order):
            raise DimensionMismatch(len(self.order), len(query))
        q = [float(query[i]) for i in self.order]
        d = {cell: float(np.sqrt(((np.asarray(self.centroids.points[cell]) - q) ** 2).sum())) for cell, _, _ in self.stats} if self.centroids.points else {}
        near, seen = [], 0
        for cell, _, n in sorted(self.stats, key=lambda s: d.get(s[0], 0)):
            near.append(cell)
            seen += n
            if seen >= k:
                break
        rows = self.members.drop("d_center")
        first = index_topk(rows.filter(F.col("cell").isin(*near)), q, k, "euclidean", "es4d").collect() if near else []
        cutoff = first[-1]["distance"] if len(first) == k else float("inf")
        cells = [c for c, radius, _ in self.stats if d.get(c, 0) - radius <= cutoff * (1 + 1e-9)]
        return index_topk(rows.filter(F.col("cell").isin(*cells) if cells else F.lit(False)).drop("cell"), q, k, "euclidean", "es4d")


def early_stop_distance(a, b, cutoff: float, shard: int = 64) -> float | None:
    """Euclidean distance summed by shards, None as soon as it is beyond the cutoff."""
    a, b, total = np.asarray(a, float), np.asarray(b, float), 0.0
    for i in range(0, len(a), shard):
        total += float(((a[i : i + shard] - b[i : i + shard]) ** 2).sum())
        if total > cutoff * cutoff:
            return None
    return total**0.5


def within_distance(rows: DataFrame, query, cutoff: float, shard: int = 16) -> DataFrame:
    """``(id, distance)`` of the records within `cutoff`, summed by shards of dimensions.

    Records whose partial sum is beyond the cutoff drop out of the batch, so
    with dimensions in order of variance most of them are given up early.
    """
    kind, q = dict(rows.dtypes)["id"], np.asarray(query, float)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            left, total = np.arange(len(x)), np.zeros(len(x))
            for i in range(0, len(q), shard):
                total[left] += ((x[left, i : i + shard].astype(np.float64) - q[i : i + shard]) ** 2).sum(axis=1)
                left = left[total[left] <= cutoff * cutoff]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(left)), pa.array(np.sqrt(total[left]))], names=["id", "distance"])

    return rows.select("id", "vector").mapInArrow(run, f"id {kind}, distance double")


def index_bytes(kind: str, n: int, d: int, *, m: int = 8, codes: int = 256, cells: int = 256, buckets: int = 0) -> int:
    """Size of an index by its closed formula."""
    return {"hnsw": n * d * 4, "es4d": n * d * 4, "sq8": n * d, "pq": n * m + m * codes * (d // m) * 4, "ivf": (n + cells) * d * 4, "lsh": buckets * 64 + n * d * 4}[kind]
