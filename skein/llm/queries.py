"""The queries of the operators in this subpackage, by problem, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import clusters, distinctive, markup, neardup, neighbours, packing, quality, sentences, splitting, tokens
from skein.llm.vectors import current_records
from skein.operators.search import batch_topk
from skein.session import cut_lineage


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.mutual_clusters(current_records(_t(spark, sf, "vector_docs"))).select("cluster_id", "id")


def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    d = clusters.describe(clusters.mutual_clusters(current_records(_t(spark, sf, "vector_docs"))))
    return d.select("cluster_id", "size", F.array_join("typical_ids", " ").alias("typical_ids"))


def _current_chunks(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Each ``chunk_id`` once: its latest delivery, ties to the greatest content."""
    c = _t(spark, sf, "chunks").filter("chunk_id IS NOT NULL")
    last = c.groupBy("chunk_id").agg(F.max(F.struct("ingested_at", "content", *columns)).alias("r"))
    return last.select("chunk_id", "r.content", *[f"r.{x}" for x in columns])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = _current_chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    vectors = current_records(_t(spark, sf, "vector_docs"))
    return neardup.similar_texts(texts).unionByName(neardup.similar_vectors(vectors))


def p2_membership(spark: SparkSession, sf: str) -> DataFrame:
    texts = _current_chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    vectors = current_records(_t(spark, sf, "vector_docs"))
    return neardup.membership(texts, "text").unionByName(neardup.membership(vectors, "vector"))


def _every_50th(name: str):
    """Whether the number in an id is divisible by 50: the query set of searches."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint") % 50 == 0, F.lit(False))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.close_pairs(current_records(_t(spark, sf, "vector_docs")))


def p3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(current_records(_t(spark, sf, "vector_docs")), 10, queries=_every_50th("id"))
    return near.select("id", "neighbour", F.round("sim", 6).alias("sim"), "rank")


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of `p3_nearest`'s operator against brute force over all records, for the records whose number is divisible by 500."""
    rows = cut_lineage(current_records(_t(spark, sf, "vector_docs")))
    asks = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint") % 500 == 0, F.lit(False))
    near = neighbours.nearest(rows, 10, queries=asks).select("id", "neighbour")
    exact = batch_topk(rows, rows.filter(asks).select(F.col("id").alias("query_id"), "vector"), 11, "cosine").filter("query_id <> id")
    w = Window.partitionBy("query_id").orderBy("rank")
    exact = exact.withColumn("r", F.row_number().over(w)).filter("r <= 10").select(F.col("query_id").alias("id"), F.col("id").alias("neighbour"))
    both = exact.join(near.withColumn("hit", F.lit(1)), ["id", "neighbour"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("at_least_90_percent"))


def _term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.term_counts(_current_chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = distinctive.residuals(_term_counts(spark, sf), only=F.col("tf") >= 3)
    return scored.filter("df BETWEEN 2 AND 5").select(F.col("id").alias("chunk_id"), "term")


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = distinctive.residuals(_term_counts(spark, sf))
    return scored.select(F.col("id").alias("chunk_id"), "term", "tf", "df", F.round("residual", 6).alias("residual"))


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean(_current_chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf).select(F.col("id").alias("chunk_id"), F.explode("markup").alias("markup"))


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf).select(F.col("id").alias("chunk_id"), F.array_join("markup", ",").alias("markup"), F.col("clean").alias("content"))


def _sized_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, text, limit, overlap)``; a null or unknown config is the one named default."""
    conf = _t(spark, sf, "chunk_configs").select("config_id", "config_name", "max_chunk_size", "overlap_size")
    default = conf.filter("config_name = 'default'").agg(F.first("max_chunk_size").alias("dm"), F.first("overlap_size").alias("do"))
    c = _current_chunks(spark, sf, "config_id").join(F.broadcast(conf), "config_id", "left").join(F.broadcast(default))  # both fixed and tiny
    return c.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), F.coalesce("max_chunk_size", "dm").alias("limit"), F.coalesce("overlap_size", "do").alias("overlap"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(_sized_chunks(spark, sf)).filter("piece = 0").select(F.col("id").alias("chunk_id"), "forced")


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(_sized_chunks(spark, sf)).select(F.col("id").alias("chunk_id"), "piece", "start", "end", "content")


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Of each cut chunk: pieces, whether all are within the limit, meet with the overlap, and cover the text."""
    rows = _sized_chunks(spark, sf)
    pieces = splitting.split(rows).join(rows.select("id", "limit", "overlap", F.char_length("text").alias("size")), "id")
    before = F.lag("end").over(Window.partitionBy("id").orderBy("piece"))
    pieces = pieces.withColumn("fits", F.coalesce(F.col("start") == before - F.col("overlap"), F.col("start") == 0))
    out = pieces.groupBy("id", "size").agg(F.count("*").alias("pieces"), F.min((F.col("end") - F.col("start") <= F.col("limit")).cast("int")).alias("within"), F.min(F.col("fits").cast("int")).alias("meet"), F.max("end").alias("last"), F.min((F.char_length("content") == F.col("end") - F.col("start")).cast("int")).alias("whole"))
    return out.select(F.col("id").alias("chunk_id"), (F.col("within") == 1).alias("within"), (F.col("meet") == 1).alias("meet"), ((F.col("last") == F.col("size")) & (F.col("whole") == 1)).alias("covers"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = _current_chunks(spark, sf, "chunk_type").filter("lower(chunk_type) = 'production'")
    return sentences.split(texts.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))).select(F.col("id").alias("chunk_id"), F.col("start").alias("sent_start"))


def p7_sentences(spark: SparkSession, sf: str) -> DataFrame:
    texts = _current_chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    return sentences.split(texts).select(F.col("id").alias("chunk_id"), "n", "start", "sentence")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(_t(spark, sf, "documents").select("doc_id", "text"))


def _containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = cut_lineage(tokens.count_tokens(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), out="size"))
    return packing.fill(sizes)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _containers(spark, sf).filter("piece = 1").select(F.col("id").alias("doc_id"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _containers(spark, sf).select(F.col("id").alias("doc_id"), "piece", "start", "size", "container")


def p9_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, whether no container is over its capacity and every document is placed whole, and whether less than 2 % of the room is lost."""
    sizes = cut_lineage(tokens.count_tokens(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), out="size"))
    placed = cut_lineage(packing.fill(sizes))
    most = placed.filter("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("n"))
    most = most.agg(F.max("n").alias("most"), F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    whole = placed.groupBy("id").agg(F.sum("size").alias("n"), F.count("*").alias("pieces")).join(sizes, "id", "full")
    whole = whole.agg(F.count("*").alias("documents"), F.min((F.coalesce("n", F.lit(-1)) == F.coalesce("size", F.lit(0))).cast("int")).alias("same"))
    return whole.join(most).select("documents", (F.col("most") <= 2048).alias("within"), (F.col("same") == 1).alias("whole"), (F.col("containers") * 2048 - F.col("tokens") <= 0.02 * F.col("containers") * 2048 + 2048).alias("tight"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), _t(spark, sf, "common_words"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).filter("form <> 'prose'").select(F.col("id").alias("doc_id"), "form")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf)
    rounded = [F.round(c, 4).alias(c) for c in quality.STATISTICS]
    return j.select(F.col("id").alias("doc_id"), "lang", *rounded, F.array_join("tails", ",").alias("tails"), "form")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_CURRENT = """cur AS (SELECT id, list_transform(v, lambda x: x::DOUBLE) AS v FROM (SELECT id, arg_max(coalesce(vector, []), updated_at) AS v FROM vector_docs WHERE id IS NOT NULL GROUP BY id)
 WHERE len(v) = 128 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
unit AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM cur)"""
_CHUNKS = "ch AS (SELECT chunk_id, arg_max(coalesce(content, ''), ingested_at) AS content, arg_max(coalesce(config_id, 0), ingested_at) AS config_id FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"
_TERMS = f"""{_CHUNKS}, tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z]{{6,}}')) AS term FROM ch) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS col_n FROM tf GROUP BY term)"""


def oracle_sql() -> dict:
    p1 = f"""WITH {_CURRENT}, nb AS (SELECT a.id, list(b.id ORDER BY b.id) AS near FROM unit a, unit b WHERE a.id = b.id OR list_dot_product(a.u, b.u) >= 0.65 GROUP BY a.id),
k AS (SELECT near[1] AS cluster_id, id, len(near) AS n, count(*) OVER (PARTITION BY near) AS alike FROM nb)
SELECT cluster_id, id FROM k WHERE n >= 5 AND alike = n"""
    p2 = f"""WITH {_CURRENT}, {_CHUNKS}, w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\\pL\\pM\\p{{Nd}}]+') AS w FROM ch),
s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS g FROM w WHERE len(w) >= 45),
c AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
j AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT x AS id_a, y AS id_b FROM j JOIN c cx ON cx.chunk_id = x JOIN c cy ON cy.chunk_id = y WHERE 2 * k >= cx.n + cy.n - k
UNION ALL SELECT a.id, b.id FROM unit a JOIN unit b ON a.id < b.id AND list_dot_product(a.u, b.u) >= 0.99"""
    p3 = f"""WITH {_CURRENT}, p AS (SELECT a.id AS x, b.id AS y, list_dot_product(a.u, b.u) AS s FROM unit a, unit b WHERE a.id <> b.id AND list_dot_product(a.u, b.u) >= 0.95),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM p)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE k <= 5"""
    p4 = f"WITH {_TERMS} SELECT chunk_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 5"
    scores = f"""WITH {_TERMS}, rn AS (SELECT chunk_id, sum(tf) AS row_n FROM tf GROUP BY chunk_id), n AS (SELECT sum(tf) AS n FROM tf),
e AS (SELECT chunk_id, term, tf, df, row_n, col_n, n, row_n::DOUBLE * col_n / n AS e FROM tf JOIN df USING (term) JOIN rn USING (chunk_id), n)
SELECT chunk_id, term, tf, df, round((tf - e) / sqrt(e * (1 - row_n::DOUBLE / n) * (1 - col_n::DOUBLE / n)), 6) AS residual FROM e"""
    p6 = f"""WITH {_CHUNKS}, m AS (SELECT chunk_id, content, coalesce(c.max_chunk_size, d.max_chunk_size) AS m FROM ch LEFT JOIN chunk_configs c USING (config_id), (SELECT max_chunk_size FROM chunk_configs WHERE config_name = 'default') d)
SELECT chunk_id, (CASE WHEN list_max(list_transform(regexp_split_to_array(content, '[\\s\\x{{0b}}\\x{{85}}\\pZ.!?;。！？；।؟]'), lambda x: length(x))) > m THEN 1 ELSE 0 END)::BIGINT AS forced FROM m WHERE length(content) > m"""
    members = f"""WITH {_CURRENT}, {_CHUNKS}, c AS (SELECT chunk_id AS id, content AS x FROM ch WHERE chunk_id IN (SELECT chunk_id FROM (SELECT chunk_id, arg_max(content IS NULL, ingested_at) AS gone FROM chunks GROUP BY chunk_id) WHERE NOT gone)),
g AS (SELECT x, min(id) AS rep, count(*) AS copies FROM c GROUP BY x HAVING count(*) > 1), h AS (SELECT v, min(id) AS rep, count(*) AS copies FROM cur GROUP BY v HAVING count(*) > 1)
SELECT id, rep, copies FROM c JOIN g USING (x) UNION ALL SELECT id, rep, copies FROM cur JOIN h USING (v)"""
    limits = p6.replace(p6[p6.index("SELECT chunk_id, (CASE") :], "SELECT chunk_id, true AS within, true AS meet, true AS covers FROM m WHERE length(content) > m")
    recall = f"WITH {_CURRENT} SELECT 10 * count(*) AS wanted, true AS at_least_90_percent FROM cur WHERE coalesce(try_cast(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) % 500 = 0, false)"
    full = "SELECT count(*) AS documents, true AS within, true AS whole, true AS tight FROM documents"
    described = f"""WITH {p1[5:].replace(chr(10) + "SELECT cluster_id, id FROM k", ", found AS (SELECT cluster_id, id FROM k")}), m AS (SELECT cluster_id, id, u FROM found JOIN unit USING (id)),
x AS (SELECT cluster_id, pos, sum(x) AS x FROM (SELECT cluster_id, unnest(u) AS x, unnest(range(0, 128)) AS pos FROM m) GROUP BY ALL), c AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM x GROUP BY cluster_id),
t AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(list_dot_product(u, c) / sqrt(list_dot_product(c, c)), 9) DESC, id) AS k FROM m JOIN c USING (cluster_id))
SELECT cluster_id, count(*) AS size, string_agg(id, ' ' ORDER BY k) FILTER (k <= 3) AS typical_ids FROM t GROUP BY cluster_id"""
    return {"p1_clusters": described, "p2_membership": members, "p3_recall": recall, "p6_invariants": limits, "p9_invariants": full, "p1_found": p1, "p2_found": p2, "p3_found": p3, "p4_found": p4, "p4_scores": scores, "p6_found": p6}
