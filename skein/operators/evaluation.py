"""Retrieval metrics as DataFrame plans over ground truth and runs.

``qrels(query_id, relevant_ids, relevance_scores)`` and
``runs(run_id, query_id, retrieved_ids, latency_ms)``. Without scores every
relevant id counts 1; a shorter list of scores cuts the list of ids. A run whose
list is null counts as empty. An id that is retrieved twice counts twice for
recall and precision. Empty ground truth gives 0 everywhere, an empty run
precision 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage


def relevance(qrels: DataFrame) -> DataFrame:
    """``(query_id, id, rel)``; the greatest relevance of an id counts."""
    q = qrels.select("query_id", "relevant_ids", "relevance_scores").filter("relevant_ids IS NOT NULL")
    graded = F.slice("relevant_ids", 1, F.least(F.size("relevant_ids"), F.when(F.col("relevance_scores").isNull(), F.size("relevant_ids")).otherwise(F.size("relevance_scores"))))
    rows = q.withColumn("ids", graded).select("query_id", "relevance_scores", F.posexplode("ids").alias("p", "id"))
    rel = F.coalesce(F.try_element_at("relevance_scores", F.col("p") + 1).cast("double"), F.lit(1.0))
    return rows.select("query_id", "id", rel.alias("rel")).groupBy("query_id", "id").agg(F.max("rel").alias("rel"))


def per_query(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``(run_id, query_id, recall, precision, rr, ap, ndcg, latency_ms)`` of runs whose query has ground truth."""
    rel = relevance(qrels)
    by_rel = Window.partitionBy("query_id").orderBy(F.desc("rel"), "id")
    ideal = rel.withColumn("i", F.row_number().over(by_rel)).groupBy("query_id").agg(
        F.count("*").alias("n_rel"),
        F.sum(F.when(F.col("i") <= k, (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("idcg"),
    )
    known = qrels.select("query_id").distinct().join(ideal, "query_id", "left").fillna(0, ["n_rel", "idcg"])
    base = runs.select("run_id", "query_id", "latency_ms", F.coalesce("retrieved_ids", F.array().cast("array<string>")).alias("ids")).join(known, "query_id")
    hits = base.select("run_id", "query_id", F.posexplode("ids").alias("p", "id")).join(rel, ["query_id", "id"])
    order = Window.partitionBy("run_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("seen", F.count("*").over(order))
    agg = hits.groupBy("run_id").agg(
        F.sum(F.when(F.col("p") < k, 1).otherwise(0)).alias("at_k"),
        F.min("p").alias("first"),
        F.sum(F.col("seen") / (F.col("p") + 1)).alias("gain"),
        F.sum(F.when(F.col("p") < k, (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("p") + 2.0)).otherwise(0.0)).alias("dcg"),
    )
    full = base.join(agg, "run_id", "left")
    zero = F.lit(0.0)
    of = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0)) / b).otherwise(zero)
    return full.select(
        "run_id", "query_id",
        of(F.col("at_k"), F.col("n_rel")).alias("recall"),
        of(F.col("at_k"), F.least(F.lit(k), F.size("ids"))).alias("precision"),
        F.coalesce(1.0 / (F.col("first") + 1), zero).alias("rr"),
        of(F.col("gain"), F.col("n_rel")).alias("ap"),
        of(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        "latency_ms",
    )


def nearest_rank(df: DataFrame, column: str, percents=(50, 95, 99)) -> list:
    """Columns of percentiles by the nearest rank ``round(p / 100 (n - 1))`` of the sorted values, null if there are none.

    The values are sorted by ranges across tasks, which count their own; only the
    ranges that hold a wanted rank are looked at, one value of each.
    """
    ranged = df.select(column).filter(F.col(column).isNotNull()).repartitionByRange(column).sortWithinPartitions(column).withColumn("p", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = sorted((r["p"], r["c"]) for r in ranged.groupBy("p").agg(F.count("*").alias("c")).collect())  # one row a task
    n, found, wanted, base = sum(c for _, c in sizes), {}, {}, 0
    for p, c in sizes:
        for q in percents:
            at = math.floor(q / 100 * (n - 1) + 0.5) - base
            if 0 <= at < c:
                wanted[q] = p, at + 1
        base += c
    if wanted:
        place = F.row_number().over(Window.partitionBy("p").orderBy(column))
        hit = ranged.filter(F.col("p").isin(*{p for p, _ in wanted.values()})).withColumn("r", place)
        hit = {(r["p"], r["r"]): r[column] for r in hit.filter(F.struct("p", "r").isin(*[F.struct(F.lit(p), F.lit(r)) for p, r in wanted.values()])).collect()}
        found = {q: hit[w] for q, w in wanted.items()}
    return [F.lit(found.get(q)).cast(dict(df.dtypes)[column]).alias(f"p{q}") for q in percents]


def report(results: DataFrame) -> DataFrame:
    """One row: means of the metrics over all runs, percentiles of the latencies that are not null."""
    means = [F.avg(c).alias(n) for c, n in (("recall", "mean_recall"), ("precision", "mean_precision"), ("rr", "mrr"), ("ap", "map"), ("ndcg", "mean_ndcg"), ("latency_ms", "mean_latency"))]
    return results.agg(F.count("*").alias("queries"), *means).select("*", *nearest_rank(results, "latency_ms"))
