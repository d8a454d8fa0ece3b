"""Searches that join arms: by text, hybrid of vectors and words, and evaluated runs.

All take batches of queries. The arms are the exact batched search over vectors
and the TF-IDF index over texts of the same records; both give ranked candidates
a query, which are few, and meet in an outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import evaluation, fusion
from skein.operators.filters import compile_filter
from skein.operators.search import batch_topk, clamp_k
from skein.operators.textindex import TextIndex
from skein.sources.embedders import Embedder, embed


def text_search(docs: DataFrame, queries: DataFrame, embedder: Embedder, k: int | None = None, kind: str = "cosine", where=None, postfilter: bool = False) -> DataFrame:
    """``(query_id, id, score, rank)`` for ``queries(query_id, text)``: embed, filter by tags, nearest neighbours.

    The filter applies before ranking; with `postfilter` to the best
    ``max(10 k, 100)`` of each query, so fewer than `k` may be left. A null text
    finds nothing.
    """
    k = clamp_k(k)
    asked = embed(queries.select("query_id", "text"), embedder).select("query_id", "vector").filter("vector IS NOT NULL")
    if where is None:
        return batch_topk(docs, asked, k, kind)
    if not postfilter:
        return batch_topk(docs.filter(compile_filter(where)), asked, k, kind)
    found = batch_topk(docs, asked, max(10 * k, 100), kind).drop("rank").join(docs.filter(compile_filter(where)).select("id"), "id", "left_semi")
    return found.withColumn("rank", F.row_number().over(fusion.best("query_id"))).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def hybrid_search(docs: DataFrame, index: TextIndex, queries: DataFrame, k: int | None = None, method=None, dense_candidates: int | None = None, sparse_candidates: int | None = None, kind: str = "cosine") -> DataFrame:
    """Fused ranking for ``queries(query_id, vector, text)`` over ``docs(id, vector)`` and a text index of the same ids.

    Candidates are ``3 k`` an arm by default; `method` is a fusion, reciprocal
    ranks by default. Gives ``query_id, id, dense_score, sparse_score,
    combined_score, matched_terms, rank``. A query without a vector or without
    known words has one arm.
    """
    k = clamp_k(k)
    dense = batch_topk(docs, queries.select("query_id", "vector").filter("vector IS NOT NULL"), dense_candidates or 3 * k, kind, fusion.DIGITS).drop("rank")
    sparse = index.search(queries.select("query_id", "text"), sparse_candidates or 3 * k).drop("rank")
    return fusion.fuse(dense, sparse, method, k, ["query_id"])


def evaluate_run(docs: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 10, kind: str = "cosine", latency_ms: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics a query and the report of an exact search with `k` results for ``queries(query_id, vector)``.

    A batched search has no latency of its own for a query; `latency_ms` is
    what to report for each, null if not given. A query that finds nothing counts.
    """
    found = batch_topk(docs, queries, k, kind)
    lists = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved_ids"))  # k a query
    runs = queries.select("query_id").join(lists, "query_id", "left")
    runs = runs.select(F.xxhash64("query_id").alias("run_id"), "query_id", "retrieved_ids", F.lit(latency_ms).cast("double").alias("latency_ms"))
    each = evaluation.per_query(runs, qrels, k)
    return each, evaluation.report(each)
