"""Stored indexes: trained, written, loaded, and kept current without a rebuild.

An index is a versioned table (`skein.sources.versions`) whose folders are cut by
``cell``, so a probe reads the files of its cells only. What was trained is kept
in the manifest. Inserts append rows; removals append tombstones to the cells of
the old rows; an update does both in one version.

| kind | cell | exact |
|---|---|---|
| linear | none | yes |
| ivf | nearest centroid | if all lists are probed |
| es4d | cluster, with its radius | yes |
| sq8 | none; a byte a dimension | no |
| pq | none; a byte a subspace | no |
| lsh | signature | no |
| hnsw | shard of a graph | no, the more the greater `ef` |
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import DatabaseError, DimensionMismatch, DuplicateVector, VectorNotFound
from skein.functions import vectors as V
from skein.operators import graph, indexes
from skein.operators.batches import add_nearest
from skein.operators.search import index_topk, rerank
from skein.session import cut_lineage
from skein.sources.versions import VersionedTable

SCHEMA = "id string, cell int, vector array<float>, codes array<int>, node int, d_center double"
KINDS = ("linear", "ivf", "es4d", "sq8", "pq", "lsh", "hnsw")


class StoredIndex:
    """An index of ``(id, vector)`` at a path; opening one that exists loads what was trained."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "ivf", metric: str = "euclidean", **config):
        if kind not in KINDS:
            raise DatabaseError(f"unknown index {kind!r}")
        self.spark, self.kind, self.metric, self.config = spark, kind, metric, config
        self.table = VersionedTable(spark, path, SCHEMA, ("id", "cell"), "cell")
        self.state: dict = self.table.manifest()["extra"]
        if self.state and self.state["kind"] != kind:
            raise DatabaseError(f"{path} holds an index of kind {self.state['kind']}")

    # Training and encoding

    def _train(self, docs: DataFrame, n: int) -> dict:
        c, out = self.config, {"kind": self.kind, "metric": self.metric}
        if self.kind == "ivf":
            out["points"] = indexes.Centroids.train(docs, c.get("nlist", 256), "euclidean", 25).points
        elif self.kind == "es4d":
            out["order"] = indexes.variance_order(docs)
            ordered = docs.withColumn("vector", V.reorder("vector", out["order"])) if out["order"] else docs
            # The root of the number of records, bounded: more clusters than this cost more to look at than they save.
            out["points"] = indexes.Centroids.train(ordered, max(1, min(4096, int(n**0.5))), "euclidean", 20).points
        elif self.kind == "sq8":
            sq = indexes.Sq8.train(docs)
            out |= {"lo": sq.lo, "scale": sq.scale}
        elif self.kind == "pq":
            out["books"] = indexes.Pq.train(docs, c.get("m", 8), c.get("codes", 256), c.get("restarts", 3), c.get("rounds", 50)).books.tolist()
        elif self.kind == "lsh":
            row = docs.select(F.size("vector").alias("d")).first()
            lsh = indexes.Lsh.make(row["d"] if row else 0, c.get("hashes", 10))
            out |= {"planes": lsh.planes.tolist(), "offsets": lsh.offsets.tolist()}
        return out

    def _encode(self, docs: DataFrame, n: int | None = None) -> DataFrame:
        """Rows of `SCHEMA` of usable vectors."""
        rows = docs.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector")).filter(V.is_valid("vector"))
        none = {"codes": F.lit(None).cast("array<int>"), "node": F.lit(None).cast("int"), "d_center": F.lit(None).cast("double"), "cell": F.lit(0)}
        s = self.state
        if self.kind in ("ivf", "es4d") and s["points"]:
            rows = rows.withColumn("vector", V.reorder("vector", s["order"])) if self.kind == "es4d" else rows
            rows = add_nearest(rows, np.asarray(s["points"]), "euclidean" if self.kind == "es4d" else self.metric, distance="d_center")
        elif self.kind == "sq8" and s["lo"]:
            rows = rows.withColumn("codes", indexes.Sq8(s["lo"], s["scale"]).encode("vector"))
        elif self.kind == "pq" and np.size(s["books"]):
            rows = indexes.Pq(np.asarray(s["books"])).encode(rows)
        elif self.kind == "lsh":
            rows = rows.withColumn("cell", indexes.Lsh(np.asarray(s["planes"]), np.asarray(s["offsets"])).signature().cast("int"))
        elif self.kind == "hnsw":
            rows = graph.build(rows, rows.count() if n is None else n, self.config.get("links", 16), self.metric, s.get("shards", 0))
        return rows.select(*[c if c in rows.columns else none[c].alias(c) for c in self.table.columns])

    def _grow(self, rows: DataFrame) -> dict:
        """What rows that have been written add to the state: sizes and radii of cells, or the number of shards."""
        if self.kind == "hnsw":
            top = rows.agg(F.max("cell")).first()[0]
            return {"shards": max(self.state.get("shards", 0), 0 if top is None else top + 1)}
        if self.kind != "es4d":
            return {}
        old = {c: (r, n) for c, r, n in self.state.get("stats", [])}
        for x in rows.groupBy("cell").agg(F.max("d_center").alias("radius"), F.count("*").alias("n")).collect():  # one row a cluster
            r, n = old.get(x["cell"], (0.0, 0))
            old[x["cell"]] = (max(r, x["radius"] or 0.0), n + x["n"])
        return {"stats": [[c, r, n] for c, (r, n) in old.items()]}

    # Writes

    def build(self, docs: DataFrame) -> StoredIndex:
        """Train on `docs` and store them, replacing what was there."""
        docs = cut_lineage(docs.select("id", "vector").filter(V.is_valid("vector")))
        n = docs.count()
        self.state = self._train(docs, n)
        rows = cut_lineage(self._encode(docs, n))
        self.state |= self._grow(rows)
        self.table.replace(rows, self.state)
        return self

    def insert(self, docs: DataFrame) -> StoredIndex:
        """Add new records; a known id raises."""
        docs = docs.select(F.col("id").cast("string").alias("id"), "vector")
        if known := docs.join(self.table.read().select("id"), "id", "left_semi").limit(1).collect():
            raise DuplicateVector(known[0]["id"])
        rows = cut_lineage(self._encode(docs))
        self.state |= self._grow(rows)
        self.table.append(rows, new=True, extra=self.state)
        return self

    def remove(self, ids: DataFrame) -> StoredIndex:
        """Remove records; an unknown id raises. Radii stay as they are, so nothing is missed."""
        ids = ids.select(F.col("id").cast("string").alias("id")).distinct()
        old = cut_lineage(ids.join(self.table.read().select("id", "cell"), "id", "left"))
        if missing := old.filter("cell IS NULL").limit(1).collect():
            raise VectorNotFound(missing[0]["id"])
        self.table.append(self.table.read().limit(0), gone=old)
        return self

    def update(self, docs: DataFrame) -> StoredIndex:
        """Replace the vectors of known ids in one version."""
        docs = cut_lineage(docs.select(F.col("id").cast("string").alias("id"), "vector"))
        old = cut_lineage(docs.select("id").join(self.table.read().select("id", "cell"), "id", "left"))
        if missing := old.filter("cell IS NULL").limit(1).collect():
            raise VectorNotFound(missing[0]["id"])
        rows = cut_lineage(self._encode(docs))
        self.state |= self._grow(rows)
        self.table.append(rows, gone=old.join(rows.select("id", "cell"), ["id", "cell"], "left_anti"), extra=self.state)
        return self

    # Reads

    def __len__(self) -> int:
        return self.table.read().count()

    def get(self, id_: str) -> DataFrame:
        return self.table.read().filter(F.col("id") == id_).select("id", "vector")

    def dimension(self) -> int | None:
        row = self.table.rows().filter("NOT gone").select(F.size("vector").alias("d")).first()
        return row["d"] if row else None

    def probe(self, query, nprobe: int = 16) -> list[int]:
        """The cells of an inverted file nearest to the query."""
        return indexes.Centroids(self.state["points"], self.metric).nearest(query, nprobe) if self.state["points"] else []

    def search(self, query, k: int = 10, nprobe: int = 16, ef: int = 64, candidates: int | None = None) -> DataFrame:
        """``id, distance, score``. With `candidates` a quantised index ranks that many of its best by the full vectors."""
        if not self.state:
            return self.spark.createDataFrame([], "id string, distance double, score double")
        d = len(self.state["points"][0]) if self.state.get("points") else self.dimension()
        if d is not None and len(query) != d:
            raise DimensionMismatch(d, len(query))
        cells = lambda c: F.col("cell").isin(*c) if c else F.lit(False)
        take = lambda rows: rows.select("id", "vector")
        if self.kind == "ivf":
            return index_topk(take(self.table.read(where=cells(self.probe(query, nprobe)))), query, k, self.metric, "ivf")
        if self.kind == "es4d":
            return self._early(query, k, cells)
        if self.kind == "hnsw":
            found = graph.search(self.table.read(), [("q", list(query))], k, ef, self.metric).select("id", "distance")
            return found.withColumn("score", V.index_score(F.col("distance"), self.metric, "hnsw")).orderBy("distance", "id")
        if self.kind == "lsh":
            lsh = indexes.Lsh(np.asarray(self.state["planes"]), np.asarray(self.state["offsets"]))
            own = lsh.of(query)
            near = self.table.read(where=cells([own, *[own ^ (1 << i) for i in range(len(lsh.planes))]]))
            if near.limit(k).count() < k:
                near = self.table.read()
            return index_topk(take(near), query, k, "cosine", "lsh")
        rows = self.table.read()
        if self.kind == "linear":
            return index_topk(take(rows), query, k, self.metric, "exact")
        coded = rows.select("id", "codes")
        most = candidates or k
        if self.kind == "pq":
            near = indexes.Pq(np.asarray(self.state["books"])).search(coded, query, most)
        else:
            near = indexes.Sq8(self.state["lo"], self.state["scale"]).search(coded, query, most, self.metric)
        return rerank(take(rows), near, query, k, self.metric) if candidates else near

    def _early(self, query, k: int, cells) -> DataFrame:
        """Exact: a cluster is read only if its nearest possible member beats the k-th best of the nearest clusters."""
        q = [float(query[i]) for i in self.state["order"]] if self.state["order"] else list(query)
        far = {c: float(np.sqrt(((np.asarray(self.state["points"][c]) - q) ** 2).sum())) for c, _, _ in self.state["stats"]}
        near, seen = [], 0
        for c, _, n in sorted(self.state["stats"], key=lambda s: far[s[0]]):
            near.append(c)
            seen += n
            if seen >= k:
                break
        rows = lambda c: self.table.read(where=cells(c)).select("id", "vector")
        first = index_topk(rows(near), q, k, "euclidean", "es4d").collect() if near else []
        cutoff = first[-1]["distance"] if len(first) == k else float("inf")
        within = rows([c for c, radius, _ in self.state["stats"] if far[c] - radius <= cutoff * (1 + 1e-9)])
        found = indexes.within_distance(within, q, cutoff * (1 + 1e-9))
        return found.withColumn("score", 1 / (1 + F.col("distance"))).orderBy("distance", "id").limit(k)
