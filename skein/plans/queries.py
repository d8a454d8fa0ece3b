"""The engine's queries over the test tables, by the operator they show, and the same in SQL."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import sql
from skein.functions import vectors as V
from skein.operators import chunkers, evaluation, fusion, indexes, rag, retrieval, search, stored, tensor, textindex
from skein.operators import filters as T
from skein.session import cut_lineage, shared_folder
from skein.sources import collection, embedders
from skein.streaming import serving

#: A fixed query of 64 values.
Q = [math.sin(i + 1) for i in range(64)]
Q_SQL = "list_transform(range(1, 65), lambda i: sin(i::DOUBLE))"
E_SQL = "(SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
L2 = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
CHUNK_SQL = "(SELECT chunk_id, arg_max(content, ingested_at) AS content FROM (SELECT chunk_id, coalesce(content, '') AS content, ingested_at FROM chunks) GROUP BY chunk_id)"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return collection.latest(_t(spark, sf, "vector_docs").filter("id IS NOT NULL"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "chunks").select("chunk_id", F.coalesce("content", F.lit("")).alias("content"), "ingested_at")
    return c.groupBy("chunk_id").agg(F.max_by("content", "ingested_at").alias("content"))


def s5_stats(spark, sf):
    return collection.stats(_docs(spark, sf))


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def s13_writes(spark, sf):
    """A collection after a batch with invalid and repeated rows, an upsert, an update and a delete."""
    e = _embeddings(spark, sf).select(F.col("id").cast("string").alias("id"), "vector", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("tags"), F.col("id").alias("n"))
    c = collection.Collection(spark, _scratch(spark, "collection"), 64)
    broken = e.filter("n % 10 = 3").withColumn("vector", F.when(F.col("n") % 20 == 3, F.slice("vector", 1, 3)).otherwise(F.transform("vector", lambda x: x * float("nan"))))
    rejected = c.create(e.filter("n % 10 <> 3").unionByName(broken).unionByName(e.filter("n % 50 = 1")), strict=False)
    minus = e.withColumn("vector", F.transform("vector", lambda x: -x))
    c.upsert(minus.filter("n % 10 = 3 AND n % 3 = 0").withColumn("tags", F.lit(None).cast("map<string,string>")))
    c.update(minus.filter("n % 10 = 5").withColumn("tags", F.lit(None).cast("map<string,string>")))
    c.delete(e.filter("n % 10 = 7").select("id"))
    kept = c.read().select("id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.try_element_at("tags", F.lit("label")).alias("label"), "dimension", F.lit(None).cast("string").alias("error"))
    return kept.unionByName(rejected.select("id", F.lit(None).cast("double").alias("first"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("dimension"), "error"))


def s2_lookup(spark, sf):
    c = collection.Collection(spark, _scratch(spark, "collection"))
    c.create(_embeddings(spark, sf).select(F.col("id").cast("string").alias("id"), "vector"))
    return c.get("7", "42", "123").select("id", "dimension", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def s3_pages(spark, sf):
    """The third page of 20 ids, each page after the last id of the one before."""
    c = collection.Collection(spark, _scratch(spark, "collection"))
    c.create(_embeddings(spark, sf).select(F.col("id").cast("string").alias("id"), "vector"))
    after = None
    for _ in range(2):
        after = c.list_ids(20, after).collect()[-1]["id"]
    return c.list_ids(20, after)


def s7_index_bytes(spark, sf):
    """The closed formulas of index sizes over the number and dimension of the vectors."""
    r = _embeddings(spark, sf).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    kinds = ("hnsw", "es4d", "sq8", "pq", "ivf", "lsh")
    return spark.createDataFrame([(k, indexes.index_bytes(k, r["n"], r["d"], buckets=100)) for k in kinds], "kind string, bytes bigint")


def s12_latest(spark, sf):
    return _docs(spark, sf).select("id", "dimension", "created_at", "updated_at")


def s21_text_records(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    r = embedders.text_records(docs, embedders.HashEmbedder(64))
    return r.select("id", F.size("vector").alias("dimension"), F.char_length(r.tags["_text"]).alias("chars"))


def v1_scalar_functions(spark, sf):
    q = search.literal(Q)
    e = _embeddings(spark, sf)
    cols = {"cosine": V.cosine("vector", q), "l2": V.l2("vector", q), "l1": V.l1("vector", q), "dot": V.dot("vector", q)}
    return e.select("id", V.is_valid("vector").alias("valid"), *[F.round(c, 6).alias(n) for n, c in cols.items()])


def v0_sql_functions(spark, sf):
    """The functions registered for SQL."""
    sql.register(spark)
    q = "array(" + ", ".join(f"{x!r}D" for x in Q) + ")"
    view = f"v_{uuid.uuid4().hex}"
    _embeddings(spark, sf).createOrReplaceTempView(view)
    v = "cast(vector AS ARRAY<DOUBLE>)"
    return spark.sql(f"SELECT id, round(cosine_similarity({v}, {q}), 6) AS cosine, round(l2_distance({v}, {q}), 6) AS l2, round(l1_distance({v}, {q}), 6) AS l1, round(dot_product({v}, {q}), 6) AS dot, is_valid_vector({v}) AS valid, size(text_tokens('One, two; a three!')) AS tokens FROM {view}")


def v5_similarities(spark, sf):
    """Similarity by kind, validity with invalid vectors, Pearson correlation, zero vectors and Hamming distance."""
    q = search.literal(Q)
    e = _embeddings(spark, sf)
    broken = F.when(F.col("id") % 3 == 0, F.transform("vector", lambda x: x / 0.0 if False else x * float("inf"))).when(F.col("id") % 3 == 1, F.slice("vector", 1, 0)).otherwise(F.col("vector"))
    return e.select("id", V.is_valid(broken).alias("valid"), F.round(V.score("vector", q, "manhattan"), 6).alias("manhattan"), F.round(V.score("vector", q, "euclidean"), 6).alias("euclidean"), F.round(V.pearson("vector", q), 6).alias("pearson"),
                    F.round(V.cosine("vector", V.zeros(64)), 6).alias("to_zero"), V.hamming(F.col("id"), F.lit(21).cast("bigint")).cast("int").alias("hamming"))


def v7_normalize(spark, sf):
    return _embeddings(spark, sf).withColumn("u", V.normalize("vector")).select("id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(V.norm("u"), 6).alias("norm"))


def v14_variance_order(spark, sf):
    e = _embeddings(spark, sf)
    place = {p: k for k, p in enumerate(indexes.variance_order(e))}  # one number a dimension
    at = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    return indexes.per_dimension(e).select("pos", F.round("variance", 8).alias("variance"), at[F.col("pos")].alias("place"))


def f8_filter(spark, sf):
    tree = T.And((T.Or((T.Equals("category", "article"), T.In("category", ("image", "none")))), T.NotEquals("status", "deleted"), T.Exists("index"), T.NotExists("no such key")))
    return _docs(spark, sf).filter(T.compile_filter(tree)).select("id")


def f8_clauses(spark, sf):
    node = T.from_clauses({"category": "article"}, {"status": "deleted"}, {"index": "626", "status": "live"})
    return _docs(spark, sf).filter(T.compile_filter(node)).select("id")


def k1_topk_cosine(spark, sf):
    return search.topk(_embeddings(spark, sf), Q, 10, "cosine").select("id", F.round("score", 6).alias("score"))


def k2_topk_euclidean(spark, sf):
    return search.topk(_embeddings(spark, sf), Q, 10, "euclidean").select("id", F.round("score", 6).alias("score"))


def _batch(spark, sf, kind):
    e = _embeddings(spark, sf)
    queries = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.batch_topk(e, queries, 10, kind).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def k3_batch_topk(spark, sf):
    return _batch(spark, sf, "cosine")


def k3_batch_dot(spark, sf):
    return _batch(spark, sf, "dot")


def k5_hash_buckets(spark, sf):
    e = _embeddings(spark, sf)
    query = e.orderBy("id").limit(1).collect()[0]["vector"]
    return indexes.HashBuckets.make(64).search(e, query, 10).select("id", F.round("score", 6).alias("score"))


def k7_index_search(spark, sf):
    return search.index_topk(_embeddings(spark, sf), Q, 10, "cosine", "hnsw", ef=200).select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def f9_postfilter(spark, sf):
    d = _embeddings(spark, sf).withColumn("tags", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return search.index_topk(d, Q, 10, "euclidean", "ivf", where=T.Equals("label", "1"), postfilter=True).select("id", F.round("distance", 6).alias("distance"))


_STORED: dict = {}


def stored_index(spark, sf, kind, **config):
    """An index over the embeddings, built once a session and loaded afterwards."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _STORED or not stored.StoredIndex(spark, _STORED[key], kind).state:
        _STORED[key] = _scratch(spark, f"index-{kind}")
        stored.StoredIndex(spark, _STORED[key], kind, **config).build(_embeddings(spark, sf))
    return stored.StoredIndex(spark, _STORED[key], kind, **config)


def _churned(spark, sf, kind, **config):
    """An index after inserts, removals and updates."""
    e = _embeddings(spark, sf)
    ix = stored.StoredIndex(spark, _scratch(spark, f"index-{kind}"), kind, **config).build(e.filter("id % 10 <> 0"))
    ix.insert(e.filter("id % 10 = 0")).remove(e.filter("id % 7 = 0"))
    return ix.update(e.filter("id % 7 <> 0 AND id % 11 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))


def _hits(found):
    return found.select("id", F.round("distance", 6).alias("distance"))


def k4_linear_churn(spark, sf):
    return _hits(_churned(spark, sf, "linear").search(Q, 10))


def k14_early_churn(spark, sf):
    return _hits(_churned(spark, sf, "es4d").search(Q, 10))


def k17_ivf_churn(spark, sf):
    return _hits(_churned(spark, sf, "ivf", nlist=32).search(Q, 10, nprobe=32))


def k9_graph_churn(spark, sf):
    """Searches of the graph after churn: rows, order, and that removed records are not found and 9 of 10 true neighbours are."""
    found = _churned(spark, sf, "hnsw").search(Q, 10, ef=200).collect()
    exact = {r["id"] for r in k4_linear_churn(spark, sf).collect()}
    row = (len(found), all(int(r["id"]) % 7 for r in found), len(exact & {r["id"] for r in found}) >= 9)
    return spark.createDataFrame([row], "found int, none_removed boolean, nine_of_ten boolean")


def _recall(spark, sf, ix, k=10, **probe):
    """Mean recall of an index over the queries whose id is divisible by 50."""
    e = _embeddings(spark, sf)
    queries = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {}
    for r in search.batch_topk(e, queries, k, "euclidean").collect():  # k rows a query
        exact.setdefault(r["query_id"], set()).add(str(r["id"]))
    asked = queries.collect()
    return sum(len(exact[q["query_id"]] & {r["id"] for r in ix.search(q["vector"], k, **probe).select("id").collect()}) for q in asked[:12]) / (k * len(asked[:12]))


def k8_graph_ef(spark, sf):
    """A greater `ef` finds no less, and a large one nearly all."""
    ix = stored_index(spark, sf, "hnsw")
    low, high = _recall(spark, sf, ix, ef=10), _recall(spark, sf, ix, ef=400)
    return spark.createDataFrame([(high >= low, high >= 0.95)], "more_with_ef boolean, nearly_all boolean")


def k13_early_exact(spark, sf):
    return _hits(stored_index(spark, sf, "es4d").search(Q, 10))


def k16_ivf(spark, sf):
    """16 of 256 lists: what is found has its true distance, and every list gives the exact result."""
    ix = stored_index(spark, sf, "ivf")
    some = {r["id"]: r["distance"] for r in ix.search(Q, 10, nprobe=16).collect()}
    e = _embeddings(spark, sf)
    true = search.index_topk(e.filter(F.col("id").cast("string").isin(*some)), Q, 10, "euclidean", "ivf").collect()
    recall = _recall(spark, sf, ix, nprobe=16)
    every = _hits(ix.search(Q, 10, nprobe=256))
    honest = len(true) == len(some) and all(abs(some[str(r["id"])] - r["distance"]) < 1e-9 for r in true)
    return every.select("*", F.lit(honest).alias("honest"), F.lit(recall >= 0.4).alias("recall_40_percent"))


def k18_sq8_ranges(spark, sf):
    return indexes.per_dimension(_embeddings(spark, sf)).select("pos", F.round(F.col("lo").cast("double"), 6).alias("lo"), F.round(F.col("hi").cast("double"), 6).alias("hi"))


def k20_sq8_search(spark, sf):
    return stored_index(spark, sf, "sq8").search(Q, 10).select("id", F.round("distance", 5).alias("distance"))


def k22_lsh(spark, sf):
    ix = indexes.Lsh.make(64)
    return ix.search(_embeddings(spark, sf).withColumn("sig", ix.signature()), Q, 10).select("id", F.round("score", 6).alias("score"))


def k21_signatures(spark, sf):
    return _embeddings(spark, sf).select("id", indexes.Lsh.make(64).signature().alias("sig"))


def _books():
    """Fixed codebooks: 8 subspaces of 16 entries."""
    return [[[math.sin(7 * m + 3 * c + 5 * w) for w in range(8)] for c in range(16)] for m in range(8)]


def k25_pq_tables(spark, sf):
    """Encoding by given codebooks and the asymmetric search."""
    e = _embeddings(spark, sf)
    ix = indexes.Pq(np.array(_books()))
    return ix.search(ix.encode(e.select("id", "vector")), Q, 10).select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def k23_pq(spark, sf):
    """Codebooks of 8 x 256 codes, 3 restarts of 50 rounds: ten found, and after reranking 200 of them at least half of the true ones."""
    ix = stored_index(spark, sf, "pq")
    found = ix.search(Q, 10).count()
    return spark.createDataFrame([(found, _recall(spark, sf, ix, candidates=200) >= 0.5)], "found bigint, half_after_rerank boolean")


def k27_threshold(spark, sf):
    return search.threshold(_embeddings(spark, sf), Q, 0.1, 100).select("id", F.round("score", 6).alias("score"))


def k29_rerank(spark, sf):
    e = _embeddings(spark, sf)
    ix = indexes.Sq8.train(e)
    near = ix.search(e.select("id", ix.encode("vector").alias("codes")), Q, 200)
    return search.rerank(e, near, Q, 10).select("id", F.round("distance", 6).alias("distance"))


def _letters(c):
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))


def t8_text_search(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "title")
    queries = d.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    hits = textindex.TextIndex(d.select("id", "text"), _letters).search(queries, 5)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join("matched_terms", " ").alias("terms"), "rank")


def t3_weights(spark, sf):
    """Raw and sublinear tf, plain and smooth idf of every posting."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ix = textindex.TextIndex(d, _letters)
    n, r = F.lit(ix.doc_count()), ix.with_df(ix.postings)
    return r.select("id", "term", textindex.raw_tf(F.col("tf")).alias("raw"), F.round(textindex.tf_weight(F.col("tf")), 6).alias("sublinear"), F.round(textindex.plain_idf(n, F.col("df")), 6).alias("plain"), F.round(textindex.idf_weight(n, F.col("df")), 6).alias("smooth"))


def t9_threshold(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "title")
    queries = d.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    hits = textindex.TextIndex(d.select("id", "text"), _letters).above(queries, 0.05)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


def t10_insertion_norms(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("seq"))
    return textindex.TextIndex(d, _letters, norms="insertion").norms().select("id", F.round("norm", 6).alias("norm"))


def t1_tokens(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return textindex.postings(d).groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


def t11_vocabulary(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return textindex.postings(d, _letters).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def _hybrid(spark, sf, method):
    """Vectors of the texts by an offline embedder and a text index of the same documents; titles ask."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "title")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).alias("low")
    first = F.transform(F.array(*[F.lit(chr(97 + i)) for i in range(16)]), lambda x: (F.length("low") - F.length(F.replace("low", x, F.lit("")))).cast("float")).alias("vector")
    # The table may be one task's; counted once, however many blocks of queries pass over it.
    docs = cut_lineage(d.select("id", low("text")).repartition("id").select("id", first))
    queries = d.filter("id % 50 = 0").select(F.col("id").alias("query_id"), low("title"), F.col("title").alias("text")).select("query_id", first, "text")
    return retrieval.hybrid_search(docs, textindex.TextIndex(d.select("id", "text"), _letters), queries, 5, method)


def h1_hybrid(spark, sf):
    out = _hybrid(spark, sf, fusion.WeightedSum(0.7, 0.3))
    return out.select("query_id", "id", F.round("dense_score", 6).alias("dense"), F.round("sparse_score", 6).alias("sparse"), F.round("combined_score", 6).alias("score"), F.array_join("matched_terms", " ").alias("terms"))


def h3_rrf(spark, sf):
    return _hybrid(spark, sf, fusion.Rrf(60)).select("query_id", "id", F.round("combined_score", 8).alias("score"))


def k31_text_search(spark, sf):
    """Titles as queries against texts, both embedded by the same provider, restricted by a tag."""
    d = _t(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), "lang").alias("tags"))
    docs = embedders.text_records(d, LetterEmbedder())
    queries = _t(spark, sf, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.col("title").alias("text"))
    return retrieval.text_search(docs, queries, LetterEmbedder(), 5, where=T.Equals("lang", "en")).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


class LetterEmbedder:
    """Counts of the letters a to p: an embedding that SQL can repeat."""

    dimension = 16

    def embed(self, texts):
        return [[float(t.lower().count(chr(97 + i))) for i in range(16)] for t in texts]


def _tensors(spark, sf):
    return _embeddings(spark, sf).select("id", F.col("vector").alias("data"), F.array(F.lit(8), F.lit(8)).alias("shape"))


def n1_access(spark, sf):
    """Validity, one value, a row, a part and a fiber of 8 x 8 tensors, and of one whose shape is wrong."""
    t = _tensors(spark, sf).withColumn("shape", F.when(F.col("id") % 5 == 0, F.array(F.lit(8), F.lit(9))).otherwise(F.col("shape")))
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return t.select("id", tensor.is_valid().alias("valid"), F.round(tensor.get([2, 3]).cast("double"), 6).alias("value"), add(tensor.row(8, 4)).alias("row"), add(tensor.subtensor([8, 8], 1, 2, 3)).alias("part"), add(tensor.fiber([8, 8], 0, [0, 5])).alias("fiber"))


def n7_store(spark, sf):
    """A tensor store after inserting, replacing and deleting."""
    store = tensor.TensorStore(spark, _scratch(spark, "tensors"))
    t = _tensors(spark, sf)
    store.insert(t)
    store.insert(t.filter("id % 3 = 0").withColumn("data", F.transform("data", lambda x: -x)).withColumn("shape", F.array(F.lit(64))))
    store.delete(t.filter("id % 4 = 0").select("id"))
    return store.read().select("id", F.round(F.col("data")[0], 6).alias("first"), F.size("shape").alias("rank"))


def n8_tensor_search(spark, sf):
    return tensor.search(_tensors(spark, sf), Q, [8, 8], 10, "cosine", agg_dim=1, weights=[float(i + 1) for i in range(8)]).select("id", F.round("score", 6).alias("score"))


def n10_shifting(spark, sf):
    return tensor.shifting_search(_tensors(spark, sf), Q[:16], [2, 8], 10, "dot").select("id", "offset", F.round("score", 6).alias("score"))


def c1_windows(spark, sf):
    return _chunks(spark, sf).select("chunk_id", F.explode(chunkers.windows("content", 400, 50)).alias("w")).select("chunk_id", F.col("w.start").cast("bigint").alias("start"), F.col("w.end").cast("bigint").alias("end"))


def c2_boundaries(spark, sf):
    return _chunks(spark, sf).select("chunk_id", F.size(chunkers.boundaries("content")).alias("n"), F.array_min(chunkers.boundaries("content")).alias("first"))


def _pieces(spark, sf, name, **more):
    """Of each text: whether its pieces keep the size, meet or overlap, cover the text but for white space, and are its slices."""
    rows = _chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    p = chunkers.chunk(rows, chunkers.ChunkingConfig(400, 50, **more), name).join(rows, "id")
    before = F.coalesce(F.lag("end_index").over(Window.partitionBy("id").orderBy("n")), F.lit(0))
    gap = F.col("text").substr(before.cast("int") + 1, F.greatest(F.lit(0), F.col("start_index") - before).cast("int"))
    p = p.withColumn("meets", F.regexp_replace(gap, r"(?U)[\s\x1c-\x1f]", "") == "").withColumn("slice", F.col("content") == F.col("text").substr(F.col("start_index").cast("int") + 1, (F.col("end_index") - F.col("start_index")).cast("int")))
    rest = F.regexp_replace(F.col("text").substr(F.col("last").cast("int") + 1, F.lit(1 << 30)), r"(?U)[\s\x1c-\x1f]", "") == ""
    out = p.groupBy("id", "text").agg(F.max(F.col("end_index") - F.col("start_index")).alias("size"), F.every("meets").alias("meets"), F.every("slice").alias("slices"), F.max("end_index").alias("last"))
    return out.select(F.col("id").alias("chunk_id"), (F.col("size") <= 400).alias("within"), "meets", "slices", rest.alias("covers"))


def c5_document(spark, sf):
    return _pieces(spark, sf, "document")


def c7_windows(spark, sf):
    """Windows of the document chunker without semantics."""
    rows = _chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    p = chunkers.chunk(rows, chunkers.ChunkingConfig(400, 50, False), "document")
    return p.select(F.col("id").alias("chunk_id"), F.col("start_index").alias("start"), F.col("end_index").alias("end"))


def _whole(spark, sf, name):
    """Every text as one piece, with its metadata."""
    rows = _chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    return chunkers.described(rows, name)


def c8_document_metadata(spark, sf):
    m = _whole(spark, sf, "document")
    return m.select(F.col("id").alias("chunk_id"), *[F.col("metadata")[k].alias(k) for k in ("word_count", "sentence_count", "paragraph_count", "avg_word_length")])


def c9_contexts(spark, sf):
    """Of each text: whether what a piece shares with its neighbours is what stands there."""
    rows = _chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    p = chunkers.chunk(rows, chunkers.ChunkingConfig(400, 50), "document").join(rows, "id")
    w = Window.partitionBy("id").orderBy("n")
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    before, after = F.col("metadata")["context_before"], F.col("metadata")["context_after"]
    end, start = F.lag("end_index").over(w).cast("int"), F.lead("start_index").over(w).cast("int")
    right = (F.coalesce(F.col("text").substr(end - size(before) + 1, size(before)) == before, end.isNull())) & F.coalesce(F.col("text").substr(start + 1, size(after)) == after, start.isNull()) & (size(before) <= 50) & (size(after) <= 50)
    return p.withColumn("right", right).groupBy("id").agg(F.every("right").alias("right"), F.count("*").alias("pieces")).select(F.col("id").alias("chunk_id"), "right")


def c10_markdown(spark, sf):
    return _pieces(spark, sf, "markdown")


def c12_markdown_lines(spark, sf):
    return _pieces(spark, sf, "markdown", preserve_semantics=False)


def c13_markdown_metadata(spark, sf):
    m = _whole(spark, sf, "markdown")
    return m.select(F.col("id").alias("chunk_id"), *[F.col("metadata")[k].alias(k) for k in ("char_count", "heading_count", "link_count", "image_count", "empty_lines")])


def c15_language(spark, sf):
    return _chunks(spark, sf).select("chunk_id", chunkers.detect_language("content").alias("language"))


def c16_code(spark, sf):
    return _pieces(spark, sf, "code")


def c18_code_lines(spark, sf):
    return _pieces(spark, sf, "code", preserve_semantics=False)


def c19_analysis(spark, sf):
    m = _whole(spark, sf, "production")
    return m.select(F.col("id").alias("chunk_id"), *[F.col("metadata")[k].alias(k) for k in ("content_type", "sentence_count", "paragraph_count", "avg_sentence_length", "avg_paragraph_length")])


def c20_adaptive(spark, sf):
    return _pieces(spark, sf, "production")


def c20_fixed(spark, sf):
    return _pieces(spark, sf, "production", strategy="fixed")


def c20_hybrid(spark, sf):
    return _pieces(spark, sf, "production", strategy="hybrid")


def c23_quality(spark, sf):
    m = _whole(spark, sf, "production")
    return m.select(F.col("id").alias("chunk_id"), *[F.col("metadata")[k].alias(k) for k in ("readability_score", "information_density", "semantic_coherence", "structural_integrity", "overall_quality")])


def _runs(spark, sf):
    r = _t(spark, sf, "search_runs").groupBy("query_id", "searched_at", "retrieved_ids", "latency_ms").agg(F.min("ingested_at").alias("i"))
    r = r.filter("latency_ms IS NULL OR latency_ms >= 0")
    return r.select(F.xxhash64("query_id", "searched_at", "retrieved_ids", "latency_ms").alias("run_id"), "query_id", "searched_at", "retrieved_ids", "latency_ms")


def _evaluated(spark, sf):
    runs = cut_lineage(_runs(spark, sf))
    return evaluation.per_query(runs, _t(spark, sf, "qrels"), 10), runs


def e1_metrics(spark, sf):
    r, runs = _evaluated(spark, sf)
    r = r.join(runs.select("run_id", "searched_at"), "run_id")
    return r.select("query_id", "searched_at", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "ap", "ndcg")])


def e7_report(spark, sf):
    r, _ = _evaluated(spark, sf)
    out = evaluation.report(cut_lineage(r))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns if c != "queries"])


def e8_run(spark, sf):
    """Ground truth from the embeddings' labels: an exact search is run and evaluated."""
    e = _embeddings(spark, sf)
    queries = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", "label")
    same = queries.select("query_id", "label").join(e.filter("id % 5 = 0").select("id", "label"), "label").groupBy("query_id").agg(F.collect_list(F.col("id")).alias("relevant_ids"))
    qrels = same.withColumn("relevance_scores", F.lit(None).cast("array<float>"))
    _, report = retrieval.evaluate_run(e.select("id", "vector"), queries.select("query_id", "vector"), qrels, 10, latency_ms=1.0)
    return report.select("queries", *[F.round(c, 6).alias(c) for c in ("mean_recall", "mean_precision", "mrr", "map", "mean_ndcg", "mean_latency")])


def r2_context(spark, sf):
    c = _t(spark, sf, "chunks").filter("content IS NOT NULL").groupBy("source_id", "chunk_id").agg(F.max_by("content", "ingested_at").alias("text"))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_id"))).withColumn("score", 1 / F.col("rank"))
    return rag.pack_context(ranked, 8000, ["source_id"]).groupBy("source_id").agg(F.count("*").alias("entries"), F.max("used").alias("bytes"))


def r1_answers(spark, sf):
    """The prompts' contexts of the titles that ask, over texts embedded offline; the model repeats what it is given."""
    d = _t(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "text")
    docs = embedders.text_records(d, LetterEmbedder())
    asked = [r["title"] for r in _t(spark, sf, "documents").filter("doc_id % 200 = 0 AND title IS NOT NULL").select("title", "doc_id").orderBy("doc_id").limit(3).collect()]
    rows = []
    for title in asked:
        got = rag.answer(docs, title, LetterEmbedder(), rag.Echo(), top_k=3, most_bytes=1 << 30)
        rows += [(title, k + 1, x["id"], round(x["score"], 6), x["text"] in got.answer) for k, x in enumerate(got.sources)]
    return spark.createDataFrame(rows, "question string, rank int, id string, score double, in_prompt boolean")


def r4_concepts(spark, sf):
    """Concepts of texts by the offline extractor: the terms of greatest tf-idf, at most three."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return rag.top_terms(textindex.TextIndex(d, _letters), 3).select("id", F.array_join("concepts", " ").alias("concepts"))


def w1_token_bucket(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"))
    return serving.limit_requests_batch(e, rate=0.001, burst=3).withColumn("wait", F.round("wait", 3))


def w4_request_metrics(spark, sf):
    e = _t(spark, sf, "events").select(F.lit("POST").alias("method"), F.concat(F.lit("/vectors/"), "user_id").alias("path"), F.col("event_type").alias("status"), F.col("value").alias("latency"), "ts")
    return serving.request_metrics(e, "1 day").select(F.col("window.start").cast("date").alias("day"), "path", "status", "requests", F.round("mean_latency", 6).alias("mean_latency"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if callable(v) and k[0] in "svfkthncerw" and "_" in k and k.split("_")[0][1:].isdigit()}


def _top(score: str, order: str = "score DESC", n: int = 10, name: str = "score", digits: int = 6) -> str:
    return f"SELECT id, round({name}, {digits}) AS {name} FROM (SELECT id, {score} AS {name} FROM {E_SQL}) ORDER BY {order.replace('score', name)}, id LIMIT {n}"


def _batch_sql(score: str) -> str:
    return f"""WITH e AS {E_SQL}, s AS (SELECT q.id AS query_id, d.id, {score} AS score FROM e q, e d WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"""


def _near(rows: str, n: int = 10) -> str:
    """The `n` nearest to the fixed query, with the ids as text."""
    return f"SELECT id::VARCHAR AS id, round(d, 6) AS distance FROM (SELECT id, {L2.format(a='v', b=Q_SQL)} AS d FROM ({rows})) ORDER BY d, id::VARCHAR LIMIT {n}"


#: White space as the chunkers take it.
WS = r"\s\x0b\x1c-\x1f\x85\pZ"

#: What is trimmed from the ends of tokens: neither alphabetic nor a number; these marks are not alphabetic.
END = r"(?:[^\pL\pM\pN]|[\x{300}-\x{344}\x{346}-\x{362}\x{93c}\x{94d}\x{e47}-\x{e4c}\x{e4e}\x{fe00}-\x{fe0f}])"


def _more_sql(text: str) -> dict:
    """The SQL of the queries over stored indexes, collections, texts and chunkers."""
    churned = f"SELECT id, CASE WHEN id % 11 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM {E_SQL} WHERE id % 7 <> 0"
    e = f"WITH e AS {E_SQL}"
    lsh = indexes.Lsh.make(64)
    planes = ", ".join(f"({i}, {t!r}, {[float(x) for x in p]!r})" for i, (p, t) in enumerate(zip(lsh.planes, lsh.offsets.tolist())))
    signed = f"p(i, t, h) AS (VALUES {planes}), g AS (SELECT id, any_value(v) AS v, sum(CASE WHEN list_dot_product(v, h) > t THEN 1 << i ELSE 0 END)::BIGINT AS sig FROM e, p GROUP BY id)"
    own = sum(1 << i for i in range(len(lsh.planes)) if float(lsh.planes[i] @ np.array(Q)) > lsh.offsets[i])
    cos = COS.format(a="v", b=Q_SQL)
    weights = ", ".join(f"({i}, {[float(x) for x in w]!r})" for i, w in enumerate(indexes.HashBuckets.make(64).weights))
    signs = "list_transform(list_zip({v}, w), lambda z: z[1] * z[2] > 0)"
    postings = text[: text.index("q AS (SELECT query_id")]
    sparse = text.replace("rank <= 5)", "rank <= {n})")
    letters = lambda c: "[" + ", ".join(f"(length(lower({c})) - length(replace(lower({c}), '{chr(97 + i)}', '')))::DOUBLE" for i in range(16)) + "]"
    safe = lambda a, b: f"CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0 ELSE {COS.format(a=a, b=b)} END"
    arms = sparse[: sparse.index("SELECT query_id, id, round(score")] + f""", lv AS (SELECT id, {letters("text")} AS v, {letters("title")} AS t FROM d),
ds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS k FROM (SELECT q.id AS query_id, x.id, {safe("q.t", "x.v")} AS s FROM lv q, lv x WHERE q.id % 50 = 0)) WHERE k <= 15),
ss AS (SELECT * FROM (SELECT query_id, id, score AS s, terms, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM r) WHERE k <= 15),
fu AS (SELECT coalesce(ds.query_id, ss.query_id) AS query_id, coalesce(ds.id, ss.id) AS id, coalesce(ds.s, 0)::DOUBLE AS a, coalesce(ss.s, 0)::DOUBLE AS b, coalesce(terms, '') AS terms, coalesce(1.0::DOUBLE / (60 + ds.k), 0) + coalesce(1.0::DOUBLE / (60 + ss.k), 0) AS rrf FROM ds FULL JOIN ss ON ds.query_id = ss.query_id AND ds.id = ss.id)"""
    top5 = lambda x: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({x}, 9) DESC, id) AS k FROM fu) WHERE k <= 5"
    blank = f"regexp_matches(content, '[^{WS}]')"
    kept = f"SELECT chunk_id, true AS within, true AS meets, true AS slices, true AS covers FROM {CHUNK_SQL} WHERE {blank}"
    chunk = f"WITH c AS (SELECT chunk_id, content, regexp_extract_all(content, '[^{WS}]+') AS w, len(regexp_extract_all(content, '[.!?]+[{WS}]+')) AS s, len(regexp_extract_all(content, '\\n[{WS}]*\\n')) AS p FROM {CHUNK_SQL} WHERE trim(content) <> '')"
    lines = f"x AS (SELECT *, regexp_split_to_array(regexp_replace(content, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}])$', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]') AS l FROM c)"
    strip = lambda v: f"regexp_replace({v}, '^[{WS}]+|[{WS}]+$', '', 'g')"
    addresses = "regexp_matches(content, 'https?://[^\\s]+') OR regexp_matches(content, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b') OR regexp_matches(content, '(?:\\+?\\d{1,3}[-. ]?)?\\(?\\d{3}\\)?[-. ]?\\d{3}[-. ]?\\d{4}\\b')"
    n_lines = "(len(content) - len(replace(content, chr(10), '')) + CASE WHEN right(content, 1) <> chr(10) THEN 1 ELSE 0 END)"
    groups = "len(regexp_extract_all(lower(x), '[aeiouy]+'))"
    moved = " OR ".join(f"contains(lower(x), '{t}')" for t in chunkers.TRANSITIONS)
    scores = f"""y AS (SELECT chunk_id, content, w, regexp_split_to_array(content, '[.!?]+[{WS}]+') AS t FROM c),
z AS (SELECT chunk_id, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(0, least(1, (206.835::DOUBLE - 1.015::DOUBLE * (len(w)::DOUBLE / len(t)) - 84.6::DOUBLE * (list_sum(list_transform(w, lambda x: greatest(1, {groups} - CASE WHEN ends_with(lower(x), 'e') AND {groups} > 1 THEN 1 ELSE 0 END)))::DOUBLE / len(w))) / 100)) END AS r,
 CASE WHEN len(w) = 0 THEN 0 ELSE (len(list_distinct(w))::DOUBLE / len(w) + len(w)::DOUBLE / len(content)) / 2 END AS d,
 CASE WHEN len(t) < 2 OR len(w) = 0 THEN 1 ELSE len(list_filter(t[2:], lambda x: {moved}))::DOUBLE / (len(t) - 1) END AS h,
 CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(t, lambda x: right({strip("x")}, 1) IN ('.', '!', '?')))::DOUBLE / len(t) END AS g FROM y)"""
    three = lambda x: f"printf('%.3f', ({x})::DOUBLE)"
    splits = " UNION ALL ".join(f"SELECT '{k}' AS kind, ({f})::BIGINT AS bytes FROM n" for k, f in (("hnsw", "n * d * 4"), ("es4d", "n * d * 4"), ("sq8", "n * d"), ("pq", "n * 8 + 8 * 256 * (d // 8) * 4"), ("ivf", "(n + 256) * d * 4"), ("lsh", "100 * 64 + n * d * 4")))
    stops = ", ".join(f"'{x}'" for x in textindex.STOP_WORDS)
    windows = "CASE WHEN length(content) <= 400 THEN 1 ELSE ceil((length(content) - 50) / 350)::INT END"
    return {
        "s2_lookup": f"SELECT id::VARCHAR AS id, 64 AS dimension, round(v[1], 6) AS first FROM {E_SQL} WHERE id IN (7, 42, 123)",
        "s3_pages": f"SELECT id FROM (SELECT id::VARCHAR AS id FROM {E_SQL}) ORDER BY id LIMIT 20 OFFSET 40",
        "s7_index_bytes": f"WITH n AS (SELECT count(*) AS n, max(len(v)) AS d FROM {E_SQL}) {splits}",
        "v0_sql_functions": f"{e} SELECT id, round({cos}, 6) AS cosine, round({L2.format(a='v', b=Q_SQL)}, 6) AS l2, round(list_sum(list_transform(list_zip(v, {Q_SQL}), lambda z: abs(z[1] - z[2]))), 6) AS l1, round(list_dot_product(v, {Q_SQL}), 6) AS dot, true AS valid, 3 AS tokens FROM e",
        "n1_access": f"{e} SELECT id, id % 5 <> 0 AS valid, round(CASE WHEN id % 5 = 0 THEN v[22] ELSE v[20] END, 6) AS value, round(list_sum(v[33:40]), 6) AS row, round(list_sum(list_transform(range(0, 8), lambda r: v[8 * r + 3] + v[8 * r + 4] + v[8 * r + 5])), 6) AS part, round(list_sum(list_transform(range(0, 8), lambda r: v[8 * r + 6])), 6) AS fiber FROM e",
        "n7_store": f"{e} SELECT id::VARCHAR AS id, round(CASE WHEN id % 3 = 0 THEN -v[1] ELSE v[1] END, 6) AS first, CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END AS rank FROM e WHERE id % 4 <> 0",
        "c9_contexts": f"SELECT chunk_id, true AS right FROM {CHUNK_SQL} WHERE {blank}",
        "s13_writes": f"""{e} SELECT id::VARCHAR AS id, round(CASE WHEN id % 10 IN (3, 5) THEN -v[1] ELSE v[1] END, 6) AS first, CASE WHEN id % 10 <> 3 THEN label::VARCHAR END AS label, 64 AS dimension, NULL::VARCHAR AS error FROM e WHERE id % 10 <> 7 AND (id % 10 <> 3 OR id % 3 = 0)
UNION ALL SELECT id::VARCHAR, NULL, NULL, NULL, CASE WHEN id % 20 = 3 THEN 'DimensionMismatch' ELSE 'InvalidVector' END FROM e WHERE id % 10 = 3 UNION ALL SELECT id::VARCHAR, NULL, NULL, NULL, 'DuplicateVector' FROM e WHERE id % 50 = 1""",
        "v5_similarities": f"""{e} SELECT id, id % 3 = 2 AS valid, round(1 / (1 + list_sum(list_transform(list_zip(v, {Q_SQL}), lambda z: abs(z[1] - z[2])))), 6) AS manhattan, round(1 / (1 + {L2.format(a="v", b=Q_SQL)}), 6) AS euclidean,
round((SELECT corr(a, b) FROM (SELECT unnest(v) AS a, unnest({Q_SQL}) AS b)), 6) AS pearson, 0.0::DOUBLE AS to_zero, bit_count(xor(id::BIGINT, 21::BIGINT))::INT AS hamming FROM e""",
        "f8_clauses": "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, vector DESC NULLS LAST) AS n FROM vector_docs WHERE id IS NOT NULL) WHERE n = 1 AND tags['category'] = 'article' AND coalesce(tags['status'], '') <> 'deleted' AND (tags['index'] = '626' OR tags['status'] = 'live')",
        "k4_linear_churn": _near(churned),
        "k14_early_churn": _near(churned),
        "k17_ivf_churn": _near(churned),
        "k9_graph_churn": "SELECT 10 AS found, true AS none_removed, true AS nine_of_ten",
        "k8_graph_ef": "SELECT true AS more_with_ef, true AS nearly_all",
        "k23_pq": "SELECT 10::BIGINT AS found, true AS half_after_rerank",
        "k5_hash_buckets": f"{e}, q AS (SELECT v AS qv FROM e ORDER BY id LIMIT 1), h(f, w) AS (VALUES {weights}), m AS (SELECT DISTINCT id FROM e, q, h WHERE {signs.format(v='v')} = {signs.format(v='qv')}) SELECT id, round({COS.format(a='v', b='qv')}, 6) AS score FROM e JOIN m USING (id), q ORDER BY {COS.format(a='v', b='qv')} DESC, id LIMIT 10",
        "k21_signatures": f"{e}, {signed} SELECT id, sig FROM g",
        "k22_lsh": f"{e}, {signed}, n AS (SELECT *, bit_count(xor(sig, {own}::BIGINT)) <= 1 AS near FROM g), m AS (SELECT count(*) FILTER (near) AS c FROM n) SELECT id, round({cos}, 6) AS score FROM n, m WHERE near OR c < 10 ORDER BY {cos} DESC, id LIMIT 10",
        "k25_pq_tables": f"""{e}, x AS (SELECT id, unnest(v) AS x, unnest(range(0, 64)) AS p FROM e), b AS (SELECT m, c, w, sin((7 * m + 3 * c + 5 * w)::DOUBLE) AS b FROM range(0, 8) m(m), range(0, 16) c(c), range(0, 8) w(w)),
d AS (SELECT id, m, c, sum((x - b) * (x - b)) AS d FROM x JOIN b ON m = p // 8 AND w = p % 8 GROUP BY ALL), k AS (SELECT id, m, arg_min(c, d) AS c FROM d GROUP BY ALL),
s AS (SELECT id, sqrt(sum(power(sin((8 * m + w + 1)::DOUBLE) - b, 2))) AS dist FROM k JOIN b USING (m, c) GROUP BY id) SELECT id, round(dist, 6) AS distance, round(1 / (1 + dist), 6) AS score FROM s ORDER BY dist, id LIMIT 10""",
        "t1_tokens": f"""WITH t AS (SELECT doc_id AS id, unnest(regexp_split_to_array(coalesce(text, ''), '[{WS},;]+')) AS t FROM documents),
l AS (SELECT id, lower(replace(regexp_replace(t, '^{END}+|{END}+$', '', 'g'), 'İ', 'i̇')) AS t FROM t) SELECT id, count(DISTINCT t) AS terms, count(*)::BIGINT AS tokens FROM l WHERE strlen(t) >= 2 AND t NOT IN ({stops}) GROUP BY id""",
        "t3_weights": postings[: postings.index("w AS (SELECT id, p.term")].rstrip().rstrip(",") + " SELECT id, term, tf::DOUBLE AS raw, round(1 + ln(tf), 6) AS sublinear, round(ln(n / df), 6) AS plain, round(ln(1 + n / df), 6) AS smooth FROM p JOIN f USING (term), n",
        "t9_threshold": sparse[: sparse.index("SELECT query_id, id, round(score")] + " SELECT query_id, id, round(score, 6) AS score FROM r WHERE score >= 0.05",
        "t10_insertion_norms": postings[: postings.index("f AS (SELECT term")].rstrip().rstrip(",") + ", o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM d), s AS (SELECT id, tf, n, count(*) OVER (PARTITION BY term ORDER BY id) AS df FROM p JOIN o USING (id)) SELECT id, round(sqrt(sum(power((1 + ln(tf)) * ln(1 + n / df), 2))), 6) AS norm FROM s GROUP BY id",
        "h1_hybrid": f"{arms} SELECT query_id, id, round(a, 6) AS dense, round(b, 6) AS sparse, round(0.7::DOUBLE * a + 0.3::DOUBLE * b, 6) AS score, terms FROM ({top5('0.7::DOUBLE * a + 0.3::DOUBLE * b')})",
        "h3_rrf": f"{arms} SELECT query_id, id, round(rrf, 8) AS score FROM ({top5('rrf')})",
        "k31_text_search": f"WITH d AS (SELECT doc_id::VARCHAR AS id, {letters('text')} AS v FROM documents WHERE text IS NOT NULL AND lang = 'en'), q AS (SELECT doc_id::VARCHAR AS query_id, {letters('title')} AS t FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL), s AS (SELECT query_id, id, {safe('t', 'v')} AS s FROM q, d) SELECT query_id, id, round(s, 6) AS score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM s) WHERE k <= 5",
        **{k: kept for k in ("c5_document", "c10_markdown", "c12_markdown_lines", "c16_code", "c18_code_lines", "c20_adaptive", "c20_fixed", "c20_hybrid")},
        "c7_windows": f'''SELECT chunk_id, i * 350 AS start, least(i * 350 + 400, n) AS "end" FROM (SELECT chunk_id, length(content) AS n, unnest(range(0, {windows})) AS i, content FROM {CHUNK_SQL}) WHERE regexp_matches(content[i * 350 + 1 : i * 350 + 400], '[^{WS}]')''',
        "c8_document_metadata": f"{chunk} SELECT chunk_id, len(w)::VARCHAR AS word_count, (s + 1)::VARCHAR AS sentence_count, (p + 1)::VARCHAR AS paragraph_count, printf('%.2f', coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::DOUBLE / greatest(1, len(w))) AS avg_word_length FROM c",
        "c13_markdown_metadata": f"{chunk}, {lines} SELECT chunk_id, len(content)::VARCHAR AS char_count, len(list_filter(l, lambda v: regexp_matches({strip('v')}, '^#{{1,6}}[{WS}]+')))::VARCHAR AS heading_count, len(regexp_extract_all(content, '\\[[^\\]]+\\]\\([^)]+\\)'))::VARCHAR AS link_count, len(regexp_extract_all(content, '!\\[[^\\]]*\\]\\([^)]+\\)'))::VARCHAR AS image_count, len(list_filter(l, lambda v: {strip('v')} = ''))::VARCHAR AS empty_lines FROM x",
        "c19_analysis": f"{chunk} SELECT chunk_id, CASE WHEN p > {n_lines} // 3 THEN 'structured' WHEN s > {n_lines} // 2 THEN 'narrative' WHEN {addresses} THEN 'technical' ELSE 'mixed' END AS content_type, (s + 1)::VARCHAR AS sentence_count, (p + 1)::VARCHAR AS paragraph_count, printf('%.2f', CASE WHEN s > 0 THEN len(content)::DOUBLE / s ELSE 0 END) AS avg_sentence_length, printf('%.2f', CASE WHEN p > 0 THEN len(content)::DOUBLE / p ELSE 0 END) AS avg_paragraph_length FROM c",
        "c23_quality": f"{chunk}, {scores} SELECT chunk_id, {three('r')} AS readability_score, {three('d')} AS information_density, {three('h')} AS semantic_coherence, {three('g')} AS structural_integrity, {three('(r + d + h + g) / 4')} AS overall_quality FROM z",
        "e8_run": f"""{e}, q AS (SELECT id AS query_id, v AS qv, label FROM e WHERE id % 50 = 0), rel AS (SELECT query_id, e.id FROM q JOIN e ON e.label = q.label AND e.id % 5 = 0), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
s AS (SELECT query_id, e.id, row_number() OVER (PARTITION BY query_id ORDER BY {COS.format(a="v", b="qv")} DESC, e.id) - 1 AS p FROM q, e), t AS (SELECT * FROM s WHERE p < 10), h AS (SELECT query_id, p, count(*) OVER (PARTITION BY query_id ORDER BY p) AS seen FROM t JOIN rel USING (query_id, id)),
a AS (SELECT query_id, count(*) AS c, min(p) AS first, sum(seen / (p + 1)) AS gain, sum(1 / log2(p + 2.0)) AS dcg FROM h GROUP BY 1), i AS (SELECT query_id, n, (SELECT sum(1 / log2(k + 2.0)) FROM range(0, least(n, 10)) r(k)) AS idcg FROM n)
SELECT count(*) AS queries, round(avg(coalesce(c, 0) / n), 6) AS mean_recall, round(avg(coalesce(c, 0) / 10), 6) AS mean_precision, round(avg(coalesce(1.0::DOUBLE / (first + 1), 0)), 6) AS mrr, round(avg(coalesce(gain, 0) / n), 6) AS map, round(avg(coalesce(dcg, 0) / idcg), 6) AS mean_ndcg, 1.0::DOUBLE AS mean_latency FROM i LEFT JOIN a USING (query_id)""",
        "r1_answers": f"""WITH d AS (SELECT doc_id::VARCHAR AS id, {letters('text')} AS v FROM documents WHERE text IS NOT NULL), q AS (SELECT title, doc_id, {letters('title')} AS t FROM documents WHERE doc_id % 200 = 0 AND title IS NOT NULL ORDER BY doc_id LIMIT 3),
s AS (SELECT title, id, {safe('t', 'v')} AS s FROM q, d) SELECT title AS question, k::INT AS rank, id, round(s, 6) AS score, true AS in_prompt FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY 1 - s, id) AS k FROM s) WHERE k <= 3""",
        "r4_concepts": postings[: postings.index("dn AS (")].rstrip().rstrip(",") + ", k AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, term) AS k FROM w) SELECT id, string_agg(term, ' ' ORDER BY k) AS concepts FROM k WHERE k <= 3 GROUP BY id",
        "w1_token_bucket": """WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS client, ts, event_id AS request_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT client, ts, request_id, t, i, true AS allowed, 0.0::DOUBLE AS wait, 2.0::DOUBLE AS tokens FROM o WHERE i = 1
UNION ALL SELECT o.client, o.ts, o.request_id, o.t, o.i, h >= 1, CASE WHEN h >= 1 THEN 0.0 ELSE (1 - h) / 0.001::DOUBLE END, CASE WHEN h >= 1 THEN h - 1 ELSE h END FROM (SELECT n.*, least(3.0::DOUBLE, r.tokens + (n.t - r.t) * 0.001::DOUBLE) AS h FROM r JOIN o n ON n.client = r.client AND n.i = r.i + 1) o)
SELECT client, ts, request_id, allowed, round(wait, 3) AS wait FROM r""",
    }


def oracle_sql() -> dict:
    latest = "(SELECT *, min(created_at) OVER (PARTITION BY id) AS c, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, vector DESC NULLS LAST) AS n FROM vector_docs WHERE id IS NOT NULL)"
    cos, dot, l2 = COS.format(a="v", b=Q_SQL), f"list_dot_product(v, {Q_SQL})", L2.format(a="v", b=Q_SQL)
    near = _near(f"SELECT id, v FROM {E_SQL}")
    sq = f"""WITH e AS {E_SQL}, x AS (SELECT id, unnest(v) AS x, unnest(range(0, 64)) AS pos FROM e),
m AS (SELECT pos, min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 255 ELSE 1 END AS sc FROM x GROUP BY pos)
SELECT id::VARCHAR AS id, round(sqrt(sum(power(lo + floor(greatest(0, least(255, (x - lo) / sc))) * sc - sin((pos + 1)::DOUBLE), 2))), 5) AS distance FROM x JOIN m USING (pos) GROUP BY id ORDER BY sqrt(sum(power(lo + floor(greatest(0, least(255, (x - lo) / sc))) * sc - sin((pos + 1)::DOUBLE), 2))), id LIMIT 10"""
    text = """WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, coalesce(title, '') AS title FROM documents),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT id, p.term, (1 + ln(tf)) * ln(1 + n / df) AS w FROM p JOIN f USING (term), n),
dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
q AS (SELECT query_id, q.term, (1 + ln(c)) * ln(1 + n / df) AS wq FROM (SELECT id AS query_id, term, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z]{3,}')) AS term FROM d WHERE id % 50 = 0) GROUP BY ALL) q JOIN f USING (term), n WHERE df / n <= 0.95),
qn AS (SELECT query_id, sqrt(sum(wq * wq)) AS qnorm FROM q GROUP BY query_id),
s AS (SELECT query_id, id, sum(w * wq) AS dot, string_agg(w.term, ' ' ORDER BY w.term) AS terms FROM w JOIN q USING (term) GROUP BY ALL),
r AS (SELECT query_id, id, dot / (norm * qnorm) AS score, terms FROM s JOIN qn USING (query_id) JOIN dn USING (id))
SELECT query_id, id, round(score, 6) AS score, terms, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id))::INT AS rank FROM r) WHERE rank <= 5"""
    runs = """runs AS (SELECT query_id, searched_at, retrieved_ids, latency_ms, row_number() OVER () AS run_id FROM (SELECT DISTINCT query_id, searched_at, retrieved_ids, latency_ms FROM search_runs WHERE latency_ms IS NULL OR latency_ms >= 0)),
rel0 AS (SELECT query_id, unnest(relevant_ids) AS id, unnest(range(1, len(relevant_ids) + 1)) AS p, relevance_scores AS s FROM qrels WHERE relevant_ids IS NOT NULL),
rel AS (SELECT query_id, id, max(coalesce(s[p]::DOUBLE, 1.0)) AS rel FROM rel0 WHERE s IS NULL OR p <= len(s) GROUP BY ALL),
ri AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS i FROM rel),
ideal AS (SELECT query_id, count(*) AS n_rel, sum(CASE WHEN i <= 10 THEN (power(2, rel) - 1) / log2(i + 1.0) ELSE 0 END) AS idcg FROM ri GROUP BY query_id),
known AS (SELECT q.query_id, coalesce(n_rel, 0) AS n_rel, coalesce(idcg, 0) AS idcg FROM (SELECT DISTINCT query_id FROM qrels) q LEFT JOIN ideal USING (query_id)),
base AS (SELECT run_id, query_id, searched_at, latency_ms, coalesce(retrieved_ids, []) AS ids, n_rel, idcg FROM runs JOIN known USING (query_id)),
pos AS (SELECT run_id, query_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS p FROM base),
hits AS (SELECT run_id, p, rel, count(*) OVER (PARTITION BY run_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS seen FROM pos JOIN rel USING (query_id, id)),
agg AS (SELECT run_id, sum(CASE WHEN p < 10 THEN 1 ELSE 0 END) AS at_k, min(p) AS first, sum(seen / (p + 1)) AS gain, sum(CASE WHEN p < 10 THEN (power(2, rel) - 1) / log2(p + 2.0) ELSE 0 END) AS dcg FROM hits GROUP BY run_id),
ev AS (SELECT query_id, searched_at, latency_ms, CASE WHEN n_rel > 0 THEN coalesce(at_k, 0) / n_rel ELSE 0 END AS recall, CASE WHEN len(ids) > 0 THEN coalesce(at_k, 0) / least(10, len(ids)) ELSE 0 END AS precision,
 coalesce(1.0 / (first + 1), 0) AS rr, CASE WHEN n_rel > 0 THEN coalesce(gain, 0) / n_rel ELSE 0 END AS ap, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg FROM base LEFT JOIN agg USING (run_id))"""
    metrics = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in ("recall", "precision", "rr", "ap", "ndcg"))
    means = ", ".join(f"round(avg({c})::DOUBLE, 6) AS {n}" for c, n in (("recall", "mean_recall"), ("precision", "mean_precision"), ("rr", "mrr"), ("ap", "map"), ("ndcg", "mean_ndcg"), ("latency_ms", "mean_latency")))
    ranks = ", ".join(f"round((SELECT latency_ms FROM l WHERE r = floor({p} / 100.0 * (n - 1) + 0.5) + 1), 6) AS p{p}" for p in (50, 95, 99))
    win = f"CASE WHEN length(content) <= 400 THEN 1 ELSE ceil((length(content) - 50) / 350)::INT END"
    out = {
        "s5_stats": f"SELECT count(*) AS total_vectors, max(dimension) AS dimension, sum(strlen(id) + 4 * coalesce(len(vector), 0) + 16 * greatest(0, coalesce(cardinality(tags), 0))) ::BIGINT AS memory_usage FROM {latest} WHERE n = 1",
        "s12_latest": f"SELECT id, dimension, c AS created_at, updated_at FROM {latest} WHERE n = 1",
        "s21_text_records": "SELECT doc_id::VARCHAR AS id, 64 AS dimension, length(text) AS chars FROM documents WHERE text IS NOT NULL",
        "v1_scalar_functions": f"SELECT id, true AS valid, round({cos}, 6) AS cosine, round({l2}, 6) AS l2, round(list_sum(list_transform(list_zip(v, {Q_SQL}), lambda z: abs(z[1] - z[2]))), 6) AS l1, round({dot}, 6) AS dot FROM {E_SQL}",
        "v7_normalize": f"SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, 1.0::DOUBLE AS norm FROM {E_SQL}",
        "v14_variance_order": f"SELECT pos::INT AS pos, round(var_pop(x), 8) AS variance, (row_number() OVER (ORDER BY var_pop(x) DESC, pos) - 1)::INT AS place FROM (SELECT unnest(v) AS x, unnest(range(0, 64)) AS pos FROM {E_SQL}) GROUP BY pos",
        "f8_filter": f"SELECT id FROM {latest} WHERE n = 1 AND tags['category'] IN ('article', 'image', 'none') AND coalesce(tags['status'], '') <> 'deleted' AND tags['index'] IS NOT NULL",
        "k1_topk_cosine": _top(cos),
        "k2_topk_euclidean": _top(f"1 / (1 + {l2})"),
        "k3_batch_topk": _batch_sql(COS.format(a="d.v", b="q.v")),
        "k3_batch_dot": _batch_sql("list_dot_product(d.v, q.v)"),
        "k7_index_search": f"SELECT id, round(1 - s, 6) AS distance, round(s, 6) AS score FROM (SELECT id, {cos} AS s FROM {E_SQL}) ORDER BY s DESC, id LIMIT 10",
        "f9_postfilter": f"SELECT id, round(d, 6) AS distance FROM (SELECT * FROM (SELECT id, label, {l2} AS d FROM {E_SQL}) ORDER BY d, id LIMIT 100) WHERE label = 1 ORDER BY d, id LIMIT 10",
        "k13_early_exact": near,
        "k16_ivf": f"SELECT *, true AS honest, true AS recall_40_percent FROM ({near})",
        "k18_sq8_ranges": f"SELECT pos::INT AS pos, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM (SELECT unnest(v) AS x, unnest(range(0, 64)) AS pos FROM {E_SQL}) GROUP BY pos",
        "k20_sq8_search": sq,
        "k27_threshold": f"SELECT * FROM ({_top(cos, n=100)}) WHERE score >= 0.1",
        "k29_rerank": _top(l2, "score", name="distance"),
        "t8_text_search": text,
        "t11_vocabulary": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY ALL) GROUP BY term",
        "n8_tensor_search": "SELECT id, round(x, 6) AS score FROM (SELECT id, (" + " + ".join(f"{i + 1} * {COS.format(a=f'v[{8 * i + 1}:{8 * i + 8}]', b=f'list_transform(range({8 * i + 1}, {8 * i + 9}), lambda i: sin(i::DOUBLE))')}" for i in range(8)) + f") / 36 AS x FROM {E_SQL}) ORDER BY x DESC, id LIMIT 10",
        "n10_shifting": f"SELECT id, o::INT AS offset, round(x, 6) AS score FROM (SELECT id, o, list_dot_product(v[o * 8 + 1 : o * 8 + 16], list_transform(range(1, 17), lambda i: sin(i::DOUBLE))) AS x FROM {E_SQL}, range(0, 7) t(o)) ORDER BY x DESC, id, o LIMIT 10",
        "c1_windows": f'SELECT chunk_id, i * 350 AS start, least(i * 350 + 400, n) AS "end" FROM (SELECT chunk_id, length(content) AS n, unnest(range(0, {win})) AS i FROM {CHUNK_SQL})',
        "c2_boundaries": f"SELECT chunk_id, len(b)::INT AS n, list_min(b)::INT AS first FROM (SELECT chunk_id, list_distinct(list_append(list_filter(range(1, length(content) + 1), lambda i: content[i] IN ('.', '!', '?', ';', chr(10))), length(content))) AS b FROM {CHUNK_SQL})",
        "c15_language": f"SELECT chunk_id, CASE WHEN contains(content, 'fn ') AND contains(content, 'let ') THEN 'rust' WHEN contains(content, 'def ') AND contains(content, 'import ') THEN 'python' WHEN contains(content, 'function ') OR contains(content, 'const ') THEN 'javascript' WHEN contains(content, 'public class ') THEN 'java' ELSE 'unknown' END AS language FROM {CHUNK_SQL}",
        "e1_metrics": f"WITH {runs} SELECT query_id, searched_at, {metrics} FROM ev",
        "e7_report": f"WITH {runs}, l AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS r, count(*) OVER () AS n FROM ev WHERE latency_ms IS NOT NULL) SELECT count(*) AS queries, {means}, {ranks} FROM ev",
        "r2_context": "WITH c AS (SELECT source_id, chunk_id, arg_max(content, ingested_at) AS text FROM chunks WHERE content IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS rank FROM c), u AS (SELECT source_id, sum(strlen(printf('[%d] (score=%.4f) ', rank, 1.0::DOUBLE / rank)) + strlen(text) + 1) OVER (PARTITION BY source_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT source_id, count(*) AS entries, max(used)::BIGINT AS bytes FROM u WHERE used <= 8000 GROUP BY source_id",
        "w4_request_metrics": "SELECT ts::DATE AS day, '/vectors/:id' AS path, event_type AS status, count(*) AS requests, round(avg(value), 6) AS mean_latency FROM events GROUP BY ALL",
    }
    return out | _more_sql(text)
