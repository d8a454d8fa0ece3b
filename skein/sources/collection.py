"""Collections: versioned tables of ``(id, vector, tags, dimension, created_at, updated_at)``.

A write adds a folder with the rows that it changes and publishes a version; see
`skein.sources.versions`. Readers see the latest version, so a write that fails
leaves the old one in place.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.errors import DatabaseError, DimensionMismatch, DuplicateVector, InvalidVector, VectorNotFound
from skein.functions import vectors as V
from skein.operators import search as S
from skein.session import cut_lineage
from skein.sources.versions import VersionedTable

SCHEMA = "id string, vector array<float>, tags map<string,string>, dimension int, created_at bigint, updated_at bigint"


class Collection:
    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, algorithm: str = "hnsw", metric: str = "euclidean"):
        if algorithm not in ("hnsw", "es4d", "ivf", "sq8", "lsh", "pq", "exact"):
            raise DatabaseError(f"unknown algorithm {algorithm!r}")
        if metric not in ("euclidean", "cosine", "dot"):
            raise DatabaseError(f"unknown metric {metric!r}")
        self.spark, self.path, self.dimension, self.algorithm, self.metric = spark, path.rstrip("/"), dimension, algorithm, metric

        self.table = VersionedTable(spark, self.path, SCHEMA)

    def versions(self) -> list[int]:
        return self.table.versions()

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def compact(self) -> None:
        self.table.compact()

    def vacuum(self, keep: int = 2) -> None:
        self.table.vacuum(keep)

    # Writes. New rows are ``(id, vector[, tags])``.

    def _new(self, rows: DataFrame, *more: str) -> DataFrame:
        if "tags" not in rows.columns:
            rows = rows.withColumn("tags", F.lit(None).cast("map<string,string>"))
        return rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("tags").cast("map<string,string>").alias("tags"), *more)

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Accepted rows, and rejected ones with ``error``; of repeated ids the first accepted by vector order stays."""
        new = self._new(rows)
        dim = self.dimension or self.infer_dimension()
        error = F.when(F.col("id").isNull(), F.lit("InvalidVector: no id")).when(~V.is_valid("vector"), F.lit("InvalidVector"))
        if dim:
            error = error.when(F.size("vector") != dim, F.lit("DimensionMismatch"))
        marked = new.withColumn("error", error)
        known = self.read().select("id", F.lit(True).alias("known"))
        marked = marked.join(known, "id", "left").withColumn("error", F.coalesce("error", F.when(F.col("known"), F.lit("DuplicateVector")))).drop("known")
        w = Window.partitionBy("id").orderBy(F.col("error").isNotNull(), "vector")
        marked = marked.withColumn("n", F.row_number().over(w)).withColumn("error", F.coalesce("error", F.when(F.col("n") > 1, F.lit("DuplicateVector")))).drop("n")
        return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL")

    def infer_dimension(self) -> int | None:
        r = self.read().select("dimension").limit(1).collect()
        return r[0]["dimension"] if r else None

    def _stamp(self, rows: DataFrame, now: int) -> DataFrame:
        return rows.withColumn("dimension", F.size("vector")).withColumn("created_at", F.lit(now).cast("bigint")).withColumn("updated_at", F.lit(now).cast("bigint")).withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))

    def create(self, rows: DataFrame, strict: bool = True) -> DataFrame:
        """Append; the rejected rows with their error. With `strict` any rejection raises before anything is written."""
        good, bad = self.split(rows)
        if strict and (first := bad.select("error", "id").limit(1).collect()):
            kind, who = first[0]["error"].split(":")[0], first[0]["id"]
            if kind == "DimensionMismatch":
                raise DimensionMismatch(self.dimension or self.infer_dimension(), who)
            raise {"DuplicateVector": DuplicateVector, "InvalidVector": InvalidVector}[kind](who)
        self.table.append(self._stamp(good, int(time.time())), new=True)
        return bad

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Insert or replace by id; the rejected rows with their error.

        ``created_at`` stays, tags stay where none are given. Of repeated ids the
        row of greatest ``seq`` counts if there is such a column, else that of
        the greatest vector.
        """
        return self._merge(rows, insert=True)

    def update(self, rows: DataFrame) -> DataFrame:
        """As `upsert`, but an id that is not there raises before anything is written."""
        if missing := rows.select(F.col("id").cast("string")).join(self.read().select("id"), "id", "left_anti").select("id").limit(1).collect():
            raise VectorNotFound(missing[0]["id"])
        return self._merge(rows, insert=False)

    def _merge(self, rows: DataFrame, insert: bool) -> DataFrame:
        now = int(time.time())
        seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
        new = self._new(rows.withColumn("seq", seq), "seq")
        dim = self.dimension or self.infer_dimension()
        error = F.when(F.col("id").isNull(), F.lit("InvalidVector: no id")).when(~V.is_valid("vector"), F.lit("InvalidVector"))
        if dim:
            error = error.when(F.size("vector") != dim, F.lit("DimensionMismatch"))
        marked = cut_lineage(new.withColumn("error", error))
        good = marked.filter("error IS NULL").groupBy("id").agg(F.max(F.struct("seq", "vector", F.map_entries("tags").alias("t"))).alias("r"))
        good = good.select("id", F.col("r.vector").alias("nv"), F.map_from_entries("r.t").alias("nt"))
        both = good.join(self.read(), "id", "left" if insert else "inner")
        tags = F.when(F.coalesce(F.size("nt"), F.lit(-1)) > 0, F.col("nt")).otherwise(F.coalesce("tags", F.create_map().cast("map<string,string>")))
        stamps = (F.coalesce("created_at", F.lit(now)).cast("bigint").alias("created_at"), F.lit(now).cast("bigint").alias("updated_at"))
        # Only the changed rows are written; the table's last row of an id counts.
        self.table.append(both.select("id", F.col("nv").alias("vector"), tags.alias("tags"), F.size("nv").alias("dimension"), *stamps))
        return marked.filter("error IS NOT NULL").select("id", "vector", "tags", "error")

    def delete(self, ids: DataFrame) -> None:
        ids = ids.select("id").distinct()
        if missing := ids.join(self.read().select("id"), "id", "left_anti").limit(1).collect():
            raise VectorNotFound(missing[0]["id"])
        self.table.append(self.read().limit(0), gone=ids)

    # Reads

    def get(self, *ids: str) -> DataFrame:
        """The records of these ids, in one job whose predicate reaches the files; an unknown one raises."""
        rows = self.table.read(where=F.col("id").isin(*ids)).collect()
        if missing := set(ids) - {r["id"] for r in rows}:
            raise VectorNotFound(min(missing))
        return self.spark.createDataFrame(rows, SCHEMA)

    def list_ids(self, limit: int | None = None, after: str | None = None, ordered: bool = True) -> DataFrame:
        """Ids in order. A page follows the last id of the one before, so it reads no more than it gives away."""
        r = self.read().select("id")
        if after is not None:
            r = r.filter(F.col("id") > after)
        r = r.orderBy("id") if ordered or limit is not None else r
        return r if limit is None else r.limit(limit)

    def __len__(self) -> int:
        return self.read().count()

    def stats(self) -> DataFrame:
        return stats(self.read())

    def gauges(self) -> DataFrame:
        """One row: vectors, dimension, estimated bytes, versions and folders."""
        return self.stats().withColumn("versions", F.lit(len(self.versions()))).withColumn("folders", F.lit(len(self.table.manifest()["folders"])))

    # Searches

    def search(self, query, k: int = 10, where=None, ef: int | None = None, postfilter: bool = False) -> DataFrame:
        """Exact, whatever the algorithm, whose distance and score it gives; `build_index` is for the approximate ones."""
        return S.index_topk(self.read(), query, S.clamp_k(k), self.metric, self.algorithm, ef, self.dimension or self.infer_dimension(), where, postfilter)

    def search_batch(self, queries: DataFrame, k: int = 10, kind: str = "cosine", where=None) -> DataFrame:
        """``(query_id, id, score, rank)`` for ``queries(query_id, vector)``."""
        docs = self.read() if where is None else self.read().filter(S.compile_filter(where))
        return S.batch_topk(docs, queries, S.clamp_k(k), kind)

    def search_text(self, queries: DataFrame, embedder, k: int = 10, kind: str = "cosine", where=None, postfilter: bool = False) -> DataFrame:
        from skein.operators.retrieval import text_search

        return text_search(self.read(), queries, embedder, k, kind, where, postfilter)

    def text_index(self, **config):
        """A text index over the texts that the records carry; built again after writes, so both stay alike."""
        from skein.operators.textindex import TextIndex

        return TextIndex(self.read().select("id", F.try_element_at("tags", F.lit("_text")).alias("text")), **config)

    def search_hybrid(self, queries: DataFrame, k: int = 10, method=None, index=None, **candidates) -> DataFrame:
        """Fused ranking for ``queries(query_id, vector, text)``."""
        from skein.operators.retrieval import hybrid_search

        return hybrid_search(self.read(), index or self.text_index(), queries, k, method, **candidates)

    def rerank(self, candidates: DataFrame, query, k: int = 10) -> DataFrame:
        return S.rerank(self.read(), candidates, query, k, self.metric)

    def build_index(self, kind: str | None = None, **config):
        """A stored index of the records beside the collection; opening one of that kind again loads it."""
        from skein.operators.stored import StoredIndex

        kind = kind or {"exact": "linear"}.get(self.algorithm, self.algorithm)
        return StoredIndex(self.spark, f"{self.path}/index-{kind}", kind, self.metric, **config).build(self.read())

    def open_index(self, kind: str | None = None, **config):
        from skein.operators.stored import StoredIndex

        kind = kind or {"exact": "linear"}.get(self.algorithm, self.algorithm)
        return StoredIndex(self.spark, f"{self.path}/index-{kind}", kind, self.metric, **config)

    def search_threshold(self, query, least: float, most: int = 100) -> DataFrame:
        return S.index_topk(self.read(), query, most, self.metric, self.algorithm).filter(F.col("score") >= least)


def stats(docs: DataFrame) -> DataFrame:
    """One row: number of vectors, dimension and estimated bytes."""
    size = F.octet_length("id") + 4 * F.coalesce(F.size("vector"), F.lit(0)) + 16 * F.greatest(F.lit(0), F.size("tags"))
    return docs.agg(F.count("*").alias("total_vectors"), F.max("dimension").alias("dimension"), F.sum(size).alias("memory_usage"))


def latest(rows: DataFrame) -> DataFrame:
    """The last record of each id by ``updated_at``, with the earliest known ``created_at``."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("vector"))
    first = Window.partitionBy("id")
    return rows.withColumn("created_at", F.min("created_at").over(first)).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
