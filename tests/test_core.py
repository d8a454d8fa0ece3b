"""Fixtures of the operators with known results."""

import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import errors
from skein.functions import vectors as V
from skein.operators import chunkers, evaluation, fusion, graph, indexes, rag, retrieval, search, stored, tensor, textindex
from skein.operators import filters as T
from skein.plans import queries
from skein.sources import embedders
from skein.sources.collection import Collection
from skein.streaming import serving

VEC = "id string, vector array<float>, tags map<string,string>"


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def lit(x):
    return F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")


def test_vector_functions(spark):
    r = one(
        spark,
        V.cosine(lit([1, 2, 3]), lit([1, 2, 3])), V.cosine(lit([1, 0, 0]), lit([0, 1, 0])), V.cosine(lit([1, 0]), lit([-1, 0])), V.cosine(lit([0, 0]), lit([1, 1])),
        V.l2(lit([0, 0]), lit([3, 4])), V.l1(lit([1, 2, 3]), lit([4, 6, 8])), V.dot(lit([1, 2, 3]), lit([4, 5, 6])), V.dot(lit([1]), lit([1, 2])),
        V.is_valid(lit([])), V.is_valid(lit([math.nan])), V.is_valid(lit([math.inf])), V.normalize(lit([3, 4])), V.hamming(F.lit(0b10101), F.lit(0b01010)), V.reorder(lit([10, 20, 30]), [2, 0, 1]),
    )
    assert [round(x, 9) for x in r[:7]] == [1, 0, -1, 0, 5, 12, 32]
    assert r[7] is None and not (r[8] or r[9] or r[10])
    assert [round(x, 6) for x in r[11]] == [0.6, 0.8] and r[12] == 5 and r[13] == [30, 10, 20]
    assert round(one(spark, V.pearson(lit([1, 2, 3, 4, 5, 6]), lit([10, 20, 30, 40, 50, 60])))[0], 9) == 1


def test_filters(spark):
    df = spark.createDataFrame([("a", {"type": "article", "tag": "news"}), ("b", {}), ("c", None), ("d", {"type": "article", "status": "deleted"})], "id string, tags map<string,string>")
    ids = lambda node: sorted(r.id for r in df.filter(T.compile_filter(node)).collect())
    assert ids(T.NotEquals("status", "deleted")) == ["a", "b", "c"]
    assert ids(T.In("type", ("article",))) == ["a", "d"] and ids(T.In("type", ())) == []
    assert ids(T.Exists("tag")) == ["a"] and ids(T.NotExists("type")) == ["b", "c"]
    assert ids(T.And(())) == ["a", "b", "c", "d"] and ids(T.Or(())) == []
    assert T.from_clauses() is None
    assert ids(T.from_clauses({"type": "article"}, {"status": "deleted"}, {"tag": "news"})) == ["a"]


def docs(spark, n=60, d=8, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return spark.createDataFrame([(f"d{i:03}", v.tolist(), {"k": str(i % 3)}) for i, v in enumerate(x)], VEC), x


def test_search_against_brute_force(spark):
    df, x = docs(spark)
    bad = df.unionByName(spark.createDataFrame([("zz", None, None), ("zy", [1.0], None), ("zx", [], None)], VEC))
    q = x[5].tolist()
    d = np.sqrt(((x.astype(float) - x[5]) ** 2).sum(axis=1))
    want = [f"d{i:03}" for i in np.argsort(d, kind="stable")[:5]]
    assert [r.id for r in search.topk(bad, q, 5, "euclidean").collect()] == want
    assert [r.id for r in search.index_topk(bad, q, 5).collect()] == want
    got = search.batch_topk(bad, spark.createDataFrame([(1, q), (2, None)], "query_id int, vector array<float>"), 5, "euclidean").orderBy("rank").collect()
    assert [r.id for r in got] == want
    assert search.topk(df, q, 5, where=T.Equals("k", "none")).count() == 0
    assert search.batch_topk(df.limit(0), spark.createDataFrame([(1, q)], "query_id int, vector array<float>")).count() == 0
    with pytest.raises(errors.DimensionMismatch):
        search.index_topk(df, [1.0], dimension=8)
    with pytest.raises(errors.InvalidVector):
        search.topk(df, [math.nan] * 8)
    tie = spark.createDataFrame([("b", [1.0, 0.0], None), ("a", [2.0, 0.0], None)], VEC)
    assert [r.id for r in search.topk(tie, [1.0, 0.0], 1).collect()] == ["a"]


def test_indexes(spark):
    df, x = docs(spark)
    q = x[7].tolist()
    want = [r.id for r in search.index_topk(df, q, 5).collect()]
    assert [r.id for r in indexes.Es4d.train(df).search(q, 5).collect()] == want
    assert [r.id for r in indexes.Ivf.train(df, 6).search(q, 5, nprobe=6).collect()] == want
    sq = indexes.Sq8.train(df)
    assert sq.search(df.select("id", sq.encode("vector").alias("codes")), q, 1).collect()[0].id == "d007"
    single = indexes.Sq8.train(spark.createDataFrame([("a", [0.0, 0.5, 1.0, -1.0], None)], VEC))
    assert single.scale == [1.0] * 4
    pq = indexes.Pq.train(df, 4, 16, 1, 10)
    assert "d007" in [r.id for r in pq.search(pq.encode(df), q, 5).collect()]
    lsh = indexes.Lsh.make(8)
    assert lsh.search(df.withColumn("sig", lsh.signature()), q, 1).collect()[0].id == "d007"
    assert indexes.HashBuckets.make(8).search(df, q, 1).collect()[0].id == "d007"
    assert indexes.early_stop_distance([10] * 4, [0] * 4, 5, 2) is None
    assert indexes.early_stop_distance([1, 0, 0, 0], [0] * 4, 100) == 1
    assert indexes.variance_order(spark.createDataFrame([("a", [1.0, 0.0, 1.0], None), ("b", [1.0, 10.0, 3.0], None), ("c", [1.0, -10.0, 5.0], None)], VEC)) == [1, 2, 0]
    assert indexes.index_bytes("sq8", 10, 8) == 80


def test_text_index(spark):
    d = spark.createDataFrame([("d1", "The quick brown fox jumps"), ("d2", "A lazy dog sleeps"), ("d3", "quick brown dogs, lazy foxes"), ("d4", None), ("d5", "machine-learning (ML) is great!")], "id string, text string")
    toks = lambda t: one(spark, textindex.tokens(F.lit(t)))[0]
    assert toks("Hello, World! This is a test.") == ["hello", "world", "test"]
    assert toks("machine-learning (ML) is great!") == ["machine-learning", "ml", "great"]
    ix = textindex.TextIndex(d)
    q = spark.createDataFrame([("q", "quick brown fox"), ("u", "unknownword")], "query_id string, text string")
    hits = ix.search(q).collect()
    assert hits and hits[0].id == "d1" and {r.query_id for r in hits} == {"q"}
    assert ix.doc_count() == 5 and ix.remove(spark.createDataFrame([("d1",)], "id string")).doc_count() == 4
    assert textindex.TextIndex(d.filter("id = 'd1'")).search(q).count() == 0  # df / N is above the limit
    seq = d.withColumn("seq", F.monotonically_increasing_id())
    assert textindex.TextIndex(seq, norms="insertion").search(q).count() > 0


def test_fusion(spark):
    dense = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "id string, score double")
    sparse = spark.createDataFrame([("b", 0.8), ("c", 0.2)], "id string, score double")
    w = {r.id: r.combined_score for r in fusion.fuse(dense, sparse, fusion.WeightedSum()).collect()}
    assert round(w["b"], 6) == 0.59 and round(w["c"], 6) == 0.06
    r = fusion.fuse(dense, sparse).collect()
    assert r[0].id == "b" and abs(r[0].combined_score - (1 / 62 + 1 / 61)) < 1e-12
    with pytest.raises(ValueError):
        fusion.parse("other")


def test_tensors(spark):
    t = spark.createDataFrame([("a", [float(x) for x in range(1, 7)], [2, 3]), ("bad", [1.0], [2, 3]), ("n", None, None)], "id string, data array<double>, shape array<int>")
    r = t.filter(tensor.is_valid()).select(tensor.get([0, 2]), tensor.row(3, 0), tensor.subtensor([2, 3], 1, 1, 2), tensor.fiber([2, 3], 0, [0, 1])).collect()
    assert len(r) == 1 and list(r[0]) == [3, [1, 2, 3], [2, 3, 5, 6], [2, 5]]
    sig = [0.0] * 18
    sig[6:12] = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    s = spark.createDataFrame([("x", sig, [6, 3])], "id string, data array<double>, shape array<int>")
    assert tensor.shifting_search(s, [1, 2, 3, 4, 5, 6], [2, 3], 1).collect()[0].offset == 2
    assert tensor.search(t, [1, 2, 3, 4, 5, 6], [2, 3], 1, agg_dim=1, weights=[10.0, 0.1]).collect()[0].id == "a"
    with pytest.raises(errors.DimensionMismatch):
        tensor.search(t, [1.0], [2, 3])


def test_metrics(spark):
    qrels = spark.createDataFrame([("q", ["a", "c", "f", "g", "h"], None), ("p", ["a", "b"], None), ("e", [], None)], "query_id string, relevant_ids array<string>, relevance_scores array<float>")
    runs = spark.createDataFrame([(1, "q", list("abcde"), 1.0), (2, "p", list("xyab"), 2.0), (3, "p", None, None), (4, "e", ["a"], 4.0)], "run_id int, query_id string, retrieved_ids array<string>, latency_ms double")
    r = {x.run_id: x for x in evaluation.per_query(runs, qrels, 5).collect()}
    assert r[1].recall == 0.4 and r[1].precision == 0.4 and round(r[2].rr, 6) == 0.333333
    assert r[3].precision == 0 and r[4].recall == 0 and r[4].ndcg == 0
    rep = evaluation.report(evaluation.per_query(runs, qrels, 5)).collect()[0]
    assert rep.queries == 4 and rep.p50 == 2.0


def test_chunkers_cover_the_text(spark):
    text = "First sentence. Second one!\n\n# Head\n\nPara twö with words.\n```\ncode\n```\n- item\n| a | b |\n" * 4 + "def f():\n    x = 1\n\n\nclass A:\n    pass\n"
    for name in chunkers.CHUNKERS:
        for keep in (True, False):
            for t in (text, "x = " + "y" * 500, "short lines\n" * 60, "# a\n" + "word " * 100):
                c = chunkers.ChunkingConfig(60, 10, keep)
                spans = chunkers.CHUNKERS[name](t, c)
                assert all(b - a <= 60 for a, b, _ in spans), (name, keep)
                assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(y[0] <= x[1] and y[1] > x[1] for x, y in zip(spans, spans[1:])), (name, keep)
    kinds = [k for _, _, k in chunkers.code_structures("use a;\nfn f() {\n  g();\n\n  h();\n}\nstruct S {\n}\nlet x = 1;\n", 400)]
    assert kinds == ["mixed", "function", "class", "mixed"]
    assert [k for _, _, k in chunkers.code_blocks("import a\n# c\nlet x = 1\ny()\n", 400)] == ["imports", "comments", "variables", "code"]
    assert [k for _, _, k in chunkers.markdown_blocks("# h\n\npara\n- a\n- b\n> q\n| t |\n```\n- c\n```\n", 400)] == ["heading", "empty", "paragraph", "list", "quote", "table", "code_block"]
    story = "It was so. " * 40
    assert [k for _, _, k in chunkers.production_spans(story, chunkers.ChunkingConfig(100, 20))][0] == "fixed"
    assert {chunkers.content_type(t) for t in (story, "a\n\nb\n\nc", "see http://x.y", "word " * 9)} == {"narrative", "structured", "technical", "mixed"}
    assert chunkers.production_spans("tok; " * 30, chunkers.ChunkingConfig(60, 5))[0] == (0, 49, "adaptive")
    code = chunkers.chunk(spark.createDataFrame([("a", "fn a() {\n  x\n}\nfn b() {\n}\n")], "id string, text string"), chunkers.ChunkingConfig(400, 100), "code").collect()
    assert [r.metadata["block_type"] for r in code] == ["function", "function"] and code[1].metadata["context_before"] == "  x\n}\n" and code[1].metadata["start_line"] == "3"
    both = chunkers.chunk(spark.createDataFrame([("a", "one two\n\nthree four\n\nfive six")], "id string, text string"), chunkers.ChunkingConfig(12, 4, overlap_in_content=True)).collect()
    assert both[1].content == "wo\n\n three four\n\n five" and both[0].metadata["word_count"] == "2"
    df = spark.createDataFrame([("a", text), ("n", None), ("e", ""), ("b", " \n ")], "id string, text string")
    rows = chunkers.chunk(df, chunkers.ChunkingConfig(60, 10), "markdown").collect()
    assert {r.id for r in rows} == {"a"} and all(text[r.start_index : r.end_index] == r.content for r in rows)
    w = df.filter("id = 'a'").select(chunkers.windows(F.lit("x" * 53), 20, 5).alias("w"), chunkers.boundaries(F.lit("First sentence. Second")).alias("b")).collect()[0]
    assert tuple(w.w[0]) == (0, 20) and w.w[-1].end == 53 and 15 in w.b
    assert [chunkers.syllables(x) for x in ("test", "testing", "beautiful")] == [1, 2, 3]
    langs = [one(spark, chunkers.detect_language(F.lit(t)))[0] for t in ("fn main() { let x = 5; }", "def main(): import os", "")]
    assert langs == ["rust", "python", "unknown"]
    with pytest.raises(ValueError):
        chunkers.ChunkingConfig(10, 10)


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    row = lambda i, v, t=None: spark.createDataFrame([(i, v, t)], VEC)
    assert len(c) == 0
    c.create(row("a", [1.0, 0.0], {"k": "v"}))
    with pytest.raises(errors.DuplicateVector):
        c.create(row("a", [1.0, 0.0]))
    with pytest.raises(errors.DimensionMismatch):
        c.create(row("b", [1.0]))
    with pytest.raises(errors.InvalidVector):
        c.create(row("b", [math.nan, 0.0]))
    bad = c.create(spark.createDataFrame([("b", [0.0, 1.0], None), ("x", [], None), (None, [1.0, 1.0], None)], VEC), strict=False)
    assert bad.count() == 2 and len(c) == 2
    c.update(row("a", [0.5, 0.5], {}))
    a = c.get("a").collect()[0]
    assert a.tags == {"k": "v"} and a.vector == [0.5, 0.5]
    c.upsert(row("z", [9.0, 9.0], {"n": "1"}))
    assert [r.id for r in c.list_ids(2, "a").collect()] == ["b", "z"]
    bad = c.upsert(spark.createDataFrame([("b", [math.nan, 1.0], None), ("w", [1.0], None)], VEC)).collect()
    assert {r.id: r.error for r in bad} == {"b": "InvalidVector", "w": "DimensionMismatch"} and c.get("b").collect()[0].vector == [0.0, 1.0]
    twice = spark.createDataFrame([("b", [5.0, 5.0], 1), ("b", [1.0, 2.0], 2)], "id string, vector array<float>, seq int")
    c.upsert(twice)
    assert c.get("b").collect()[0].vector == [1.0, 2.0]
    assert c.search([9.0, 9.0], 1).collect()[0].id == "z"
    c.delete(row("z", None).select("id"))
    with pytest.raises(errors.VectorNotFound):
        c.get("z")
    with pytest.raises(errors.VectorNotFound):
        c.delete(row("z", None).select("id"))
    assert c.stats().collect()[0].total_vectors == 2
    late = Collection(spark, str(tmp_path / "c"))
    late.table.versions = lambda known=late.table.versions(): known[:-1]  # a writer that has not seen the last version
    with pytest.raises(errors.DatabaseError):
        late.create(row("q", [1.0, 1.0]))
    assert len(c) == 2
    c.compact()
    c.vacuum(1)
    assert len(c.versions()) == 1 and len(c) == 2 and len(c.table.manifest()["folders"]) == 1


def test_rag(spark):
    e = embedders.HashEmbedder(64)
    t = spark.createDataFrame([("a", "vector index search"), ("b", "text ranking model"), ("c", "index pruning for vector search"), ("n", None)], "id string, text string")
    recs = embedders.text_records(t, e)
    assert recs.count() == 3 and recs.filter("id = 'a'").collect()[0].tags == {"_text": "vector index search"}
    got = rag.answer(recs, "vector index", e, lambda p: f"{len(p) > 0}", top_k=2)
    assert got.answer == "True" and {s["id"] for s in got.sources} == {"a", "c"}
    assert rag.answer(recs, "vector index", e, lambda p: p, most_bytes=0).sources == []
    bare = spark.createDataFrame([("z", [float(i == 0) for i in range(64)], {"k": "v", "a": "b"})], VEC)
    assert rag.answer(bare, "x", e, rag.Echo(), top_k=1).sources[0]["text"] == "z a=b k=v"
    long = rag.answer(recs, "vector index", e, rag.Echo(), prompt="Q {question} C {context}")
    assert long.answer.startswith("Q vector index C [1] (score=") and rag.snippet("x" * 300) == "x" * 200 + "..."
    assert rag.concepts_by(lambda p: "- one\n- " + str(len(p)), "q")("t" * 900)[0] == "one"
    terms = rag.top_terms(textindex.TextIndex(t.filter("text IS NOT NULL")), 2).collect()
    assert {r.id: len(r.concepts) for r in terms} == {"a": 2, "b": 2, "c": 2}
    nodes = rag.expand(recs, "vector index", e, lambda x: x.split(), seeds=1, most=2)
    assert nodes.count() <= 2 and rag.synthesize(nodes, "q", lambda p: "ok") == "ok"
    assert rag.parse_concepts("- one\n2. two things\nx\n") == ["one", "two things"]
    with pytest.raises(ValueError):
        embedders.create("nothing")


def test_token_bucket(spark):
    ok = [serving.bucket_step(5, 0, 0, 10, 5)]
    tokens, out = 5.0, []
    for _ in range(6):
        a, w, tokens = serving.bucket_step(tokens, 0, 0, 10, 5)
        out.append((a, w > 0))
    assert ok[0][0] and [a for a, _ in out] == [True] * 5 + [False] and out[5][1]
    ev = spark.sql("SELECT 'c' AS client, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS ts, id AS request_id FROM range(8)")
    batch = serving.limit_requests_batch(ev, 0.5, 2).orderBy("request_id").collect()
    assert [r.allowed for r in batch] == [True, True, True, False, True, False, True, False]
    paths = spark.createDataFrame([("/vectors/abc",), ("/vectors/batch",), ("/search",)], "path string").select(serving.normalize_path("path")).collect()
    assert [r[0] for r in paths] == ["/vectors/:id", "/vectors/batch", "/search"]
    ips = spark.createDataFrame([("1.2.3.4, 5.6.7.8", None), (None, "9.9.9.9"), ("", None)], "f string, r string").select(serving.client_ip("f", "r")).collect()
    assert [r[0] for r in ips] == ["1.2.3.4", "9.9.9.9", "127.0.0.1"]


@pytest.mark.parametrize("kind", stored.KINDS)
def test_stored_indexes(spark, tmp_path, kind):
    df, x = docs(spark, 90)
    path = str(tmp_path / kind)
    ix = stored.StoredIndex(spark, path, kind, nlist=6, codes=16, restarts=1, rounds=10, m=4)
    assert ix.search([0.0] * 8).count() == 0
    df = df.select("id", "vector")
    ix.build(df.filter("id < 'd060'"))
    ix.insert(df.filter("id >= 'd060'"))
    ix.remove(df.filter("id IN ('d007', 'd070')"))
    ix.update(df.filter("id = 'd010'").withColumn("vector", F.transform("vector", lambda v: -v)))
    with pytest.raises(errors.DuplicateVector):
        ix.insert(df.filter("id = 'd001'"))
    with pytest.raises(errors.VectorNotFound):
        ix.remove(df.filter("id = 'd007'"))
    with pytest.raises(errors.VectorNotFound):
        ix.update(df.filter("id = 'd007'"))
    again = stored.StoredIndex(spark, path, kind)  # loads what was trained
    now = x.astype(float).copy()
    now[10] *= -1
    d = np.sqrt(((now - x[5]) ** 2).sum(axis=1))
    d[[7, 70]] = np.inf
    want = [f"d{i:03}" for i in np.argsort(d, kind="stable")[:5]]
    got = [r.id for r in again.search(x[5].tolist(), 5, nprobe=6, ef=40).collect()]
    assert len(again) == 88 and len(got) == 5 and not {"d007", "d070"} & set(got)
    if kind in ("linear", "ivf", "es4d"):
        assert got == want
    elif kind == "hnsw":
        assert len(set(got) & set(want)) >= 4
    else:
        assert got[0] == "d005" or kind == "pq"
    if kind in ("sq8", "pq"):
        assert [r.id for r in again.search(x[5].tolist(), 5, candidates=60).collect()][:3] == want[:3]
    with pytest.raises(errors.DimensionMismatch):
        again.search([1.0], 5)
    with pytest.raises(errors.DatabaseError):
        stored.StoredIndex(spark, path, "lsh" if kind != "lsh" else "pq")


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 32))
    near = graph.link(x, 4, "euclidean")
    hit = {10: 0, 200: 0}
    for q in x[:40] + 0.1:
        want = set(np.argsort(((x - q) ** 2).sum(axis=1))[:10].tolist())
        for ef in hit:
            hit[ef] += len(want & {i for _, i in graph.walk(x, near, q, max(10, ef), "euclidean")[:10]})
    assert hit[200] >= 0.9 * 400 and hit[200] > hit[10]


class _Service(BaseHTTPRequestHandler):
    """Stands in for the services of embeddings and chats."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        _Service.seen.append((self.path, body, self.headers.get("Authorization")))
        texts = body.get("input") or body.get("inputs") or body.get("texts") or []
        vectors = [[float(len(t)), 1.0] for t in texts]
        if self.path == "/api/chat":
            out = {"message": {"content": body["messages"][-1]["content"].upper()}}
        elif self.path == "/chat/completions":
            out = {"choices": [{"message": {"content": body["messages"][0]["content"]}}] if body["model"] != "none" else []}
        elif self.path == "/embeddings":
            out = {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]}
        else:
            out = vectors if "feature-extraction" in self.path else {"embeddings": vectors}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_providers(spark, service, monkeypatch):
    texts = spark.createDataFrame([("a", "abc"), ("b", "defgh"), ("n", None)], "id string, text string")
    for name, more in (("ollama", {}), ("openai", {"key": "k"}), ("huggingface", {"key": "k"}), ("cohere", {"key": "k"})):
        e = embedders.create(name, url=service, **more)
        rows = {r.id: r.vector for r in embedders.embed(texts, e).collect()}
        assert rows == {"a": [3.0, 1.0], "b": [5.0, 1.0], "n": None}, name
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError):
        embedders.create("openai")
    assert rag.create_llm("ollama", url=service, system_prompt="s")("hi") == "HI" and _Service.seen[-1][1]["messages"][0]["role"] == "system"
    assert rag.create_llm("openai", url=service, key="k")("hi") == "hi" and _Service.seen[-1][2] == "Bearer k"
    with pytest.raises(ValueError):
        rag.create_llm("openai", url=service, key="k", model="none")("hi")
    with pytest.raises(ValueError):
        rag.create_llm("openai")
    with pytest.raises(ValueError):
        rag.create_llm("other")


def test_tensor_store(spark, tmp_path):
    store = tensor.TensorStore(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, data array<double>, shape array<int>")
    store.insert(rows(("a", [1.0, 2.0], [2]), ("b", [3.0], [1])))
    store.insert(rows(("a", [5.0, 6.0, 7.0, 8.0], [2, 2])))
    assert store.get("a").collect()[0].data == [5.0, 6.0, 7.0, 8.0] and len(store) == 2
    with pytest.raises(errors.InvalidVector):
        store.insert(rows(("c", [1.0], [2])))
    store.delete(rows(("b", None, None)).select("id"))
    assert [r.id for r in store.list_ids().collect()] == ["a"]
    with pytest.raises(errors.VectorNotFound):
        store.get("b")
    with pytest.raises(errors.VectorNotFound):
        store.delete(rows(("b", None, None)).select("id"))


def test_retrieval(spark, tmp_path):
    e = embedders.HashEmbedder(64)
    t = spark.createDataFrame([("a", "vector index search", "x"), ("b", "text ranking model", "y"), ("c", "index pruning for vectors", "x")], "id string, text string, g string")
    c = Collection(spark, str(tmp_path / "c"), metric="cosine")
    c.create(embedders.text_records(t.select("id", "text", F.create_map(F.lit("g"), "g").alias("tags")), e))
    q = spark.createDataFrame([("q1", "ranking model"), ("q2", None)], "query_id string, text string")
    assert [(r.query_id, r.id) for r in c.search_text(q, e, 1).collect()] == [("q1", "b")]
    assert {r.id for r in c.search_text(q, e, 3, where=T.Equals("g", "x")).collect()} == {"a", "c"}
    assert {r.id for r in c.search_text(q, e, 3, where=T.Equals("g", "x"), postfilter=True).collect()} == {"a", "c"}
    asked = embedders.embed(q, e)
    got = c.search_hybrid(asked, 2).collect()
    assert got[0].id == "b" and got[0].matched_terms == ["model", "ranking"] and {r.query_id for r in got} == {"q1"}
    assert c.search_batch(asked.select("query_id", "vector"), 1).collect()[0].id == "b"
    ix = c.build_index("ivf", nlist=2)
    assert [r.id for r in ix.search(e.embed(["ranking model"])[0], 1).collect()] == ["b"] == [r.id for r in c.open_index("ivf").search(e.embed(["ranking model"])[0], 1).collect()]
    assert c.gauges().collect()[0].folders == 1 and [r.id for r in c.rerank(t.select("id"), e.embed(["ranking model"])[0], 1).collect()] == ["b"]
    qrels = spark.createDataFrame([("q1", ["b"], None), ("q2", ["a"], None)], "query_id string, relevant_ids array<string>, relevance_scores array<float>")
    each, report = retrieval.evaluate_run(c.read(), asked.select("query_id", "vector"), qrels, 2)
    assert {r.query_id: r.rr for r in each.collect()} == {"q1": 1.0, "q2": 0.0} and report.collect()[0].mrr == 0.5 and report.collect()[0].p50 is None


def test_percentiles_and_places(spark):
    df = spark.range(1000).select((F.pmod(F.col("id") * 7919, F.lit(1000)) / 10).alias("x")).unionByName(spark.createDataFrame([(None,)], "x double"))
    assert list(df.agg(F.count("*").alias("n")).select(*evaluation.nearest_rank(df, "x")).collect()[0]) == [50.0, 94.9, 98.9]
    at = textindex.insertion_numbers(spark.range(500).select((F.col("id") * 3).alias("id"), (-F.col("id")).alias("seq"))).collect()
    assert {r.id: r.n for r in at} == {3 * i: 500 - i for i in range(500)}


def test_ties_and_batches(spark):
    rows = spark.createDataFrame([(f"d{i:02}", [1.0, float(i % 3)]) for i in range(40)], "id string, vector array<float>").repartition(5)
    q = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(3)], "query_id int, vector array<float>")
    got = search.batch_topk(rows, q, 4).orderBy("query_id", "rank").collect()
    assert [r.id for r in got] == ["d00", "d03", "d06", "d09"] * 3


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    ev = spark.sql("SELECT if(id < 8, 'c', 'd') AS client, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS ts, id AS request_id FROM range(10)")
    ev.filter("request_id < 4").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")

    def run():
        serving.limit_requests(source, 0.5, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)

    run()
    ev.filter("request_id >= 4").write.mode("append").parquet(f"{tmp_path}/in")
    run()  # the state of a client goes on from one batch to the next
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("client", "request_id", "allowed").orderBy("request_id").collect()]
    want = [tuple(r) for r in serving.limit_requests_batch(ev, 0.5, 2).select("client", "request_id", "allowed").orderBy("request_id").collect()]
    assert got == want and [a for _, _, a in got][:8] == [True, True, True, False, True, False, True, False]
    c = Collection(spark, f"{tmp_path}/c")
    spark.createDataFrame([("a", [1.0], None)], VEC).write.parquet(f"{tmp_path}/vin")
    for v in (2.0, None):
        stream = serving.upsert_stream(spark.readStream.schema(VEC).parquet(f"{tmp_path}/vin"), c, f"{tmp_path}/vcp")
        stream.processAllAvailable()
        stream.stop()
        if v:
            spark.createDataFrame([("a", [v], {"k": "v"})], VEC).write.mode("append").parquet(f"{tmp_path}/vin")
    assert [(r.vector, r.tags) for r in c.read().collect()] == [([2.0], {"k": "v"})]


def test_scratch_tables(spark):
    from skein import session

    with session.scratch():
        cut = session.cut_lineage(spark.range(3))
        path = cut._table[1]
        assert cut.count() == 3 and Path(path.removeprefix("file:")).exists()
    assert not Path(path.removeprefix("file:")).exists()


def test_config(spark, tmp_path):
    from skein.config import EngineConfig

    c = EngineConfig.of({"path": str(tmp_path), "algorithm": "ivf", "nlist": 2, "dimension": 2})
    c.collection(spark).create(spark.createDataFrame([("a", [1.0, 0.0], None), ("b", [0.0, 1.0], None)], VEC))
    assert [r.id for r in c.build_index(spark).search([0.0, 1.0], 1).collect()] == ["b"]
    assert c.make_llm()("x") == "x" and c.make_embedder().dimension == 384 and c.as_dict()["nlist"] == 2
    for bad in ({"algorithm": "x"}, {"metric": "x"}, {"nlist": 0}, {"overlap_size": 5000}, {"colour": 1}):
        with pytest.raises((ValueError, errors.DatabaseError)):
            EngineConfig.of({"path": "p"} | bad)


def test_within_distance(spark):
    df, x = docs(spark, 200, 40)
    d = np.sqrt(((x.astype(float) - x[3]) ** 2).sum(axis=1))
    got = {r.id: r.distance for r in indexes.within_distance(df, x[3].tolist(), 8.0).collect()}
    assert set(got) == {f"d{i:03}" for i in np.nonzero(d <= 8)[0]} and all(abs(got[f"d{i:03}"] - d[i]) < 1e-6 for i in np.nonzero(d <= 8)[0])


def test_threshold_gives_every_document(spark, tmp_path):
    rows = [(i, "alpha beta" if i % 4 else "gamma", "alpha" if i == 50 else "none of these") for i in range(1, 1801)]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.id for r in queries.t9_threshold(spark, str(tmp_path)).collect()]
    assert sorted(got) == [i for i in range(1, 1801) if i % 4]  # 1,350 of one query


def test_postings_of_a_document_come_together(spark):
    d = spark.range(0, 3000, 1, 1).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id") % (7 + i)) for i in range(40)]).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ix = textindex.TextIndex(d)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = ix.postings.select("id", F.input_file_name().alias("file")).distinct()
    assert files.select("file").distinct().count() > 1 and files.groupBy("id").count().filter("count > 1").count() == 0


def test_text_search_in_blocks(spark, monkeypatch):
    """Blocks of any size give what all weights at once give, and no task gives more than its best."""
    monkeypatch.setattr(textindex, "CELLS", 64)
    monkeypatch.setattr(textindex, "TERM_BLOCK", 20)
    rng = np.random.default_rng(5)
    texts = {f"d{i:03}": [f"w{t}" for t in rng.zipf(1.5, 12) % 30] for i in range(200)}
    asked = {i: [f"w{t}" for t in rng.zipf(1.4, 3) % 30] for i in range(25)}
    ix = textindex.TextIndex(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id string, text string"))
    queries_ = spark.createDataFrame([(i, " ".join(t)) for i, t in asked.items()], "query_id bigint, text string")
    df = {t: sum(t in x for x in texts.values()) for x in texts.values() for t in x}
    weigh = lambda x, known: {t: (1 + math.log(x.count(t))) * math.log(1 + 200 / df[t]) for t in set(x) if t in df and (known or df[t] / 200 <= 0.95)}
    size = lambda w: math.sqrt(sum(v * v for v in w.values()))
    want, above = {}, set()
    for q, x in asked.items():
        wq = weigh(x, False)
        found = []
        for i, y in texts.items():
            w = weigh(y, True)
            both = sorted(wq.keys() & w.keys())
            if both:
                s = sum(wq[t] * w[t] for t in both) / size(wq) / size(w)
                found.append((-round(s, 9), i, both))
                if s >= 0.4:
                    above.add((q, i))
        want |= {(q, r + 1): (i, both) for r, (_, i, both) in enumerate(sorted(found)[:3])}
    assert {(r.query_id, r["rank"]): (r.id, r.matched_terms) for r in ix.search(queries_, 3).collect()} == want
    assert {(r.query_id, r.id) for r in ix.above(queries_, 0.4).collect()} == above
    q = ix.asked(queries_)
    hits = ix.hits(q)
    sent = ix.scored(q, hits, 3, None).groupBy("query_id", F.spark_partition_id()).count()
    assert sent.filter("count > 3").count() == 0 < ix.scored(q, hits, None, None).groupBy("query_id").count().filter("count > 3").count()


def test_dense_batches_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 50)
    x = np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32)
    docs = spark.createDataFrame([(f"d{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<float>")
    for kind, digits in (("cosine", None), ("cosine", 2), ("dot", None)):
        got = search.batch_topk(docs, docs.limit(20).select(F.col("id").alias("query_id"), "vector"), 4, kind, digits).collect()
        s = x.astype(float) @ x.astype(float).T / (np.outer(*[np.linalg.norm(x.astype(float), axis=1)] * 2) if kind == "cosine" else 1)
        for i in range(20):
            place = s[i] if digits is None else np.floor(s[i] * 100 + 0.5)
            want = sorted(range(300), key=lambda j: (-place[j], j))[:4]
            assert [r.id for r in sorted((r for r in got if r.query_id == f"d{i:03}"), key=lambda r: r["rank"])] == [f"d{j:03}" for j in want]
    def bounded(x, q, kind):
        assert len(x) * len(q) <= 50
        return x @ q.T

    monkeypatch.setattr(search, "_scores", bounded)
    assert search.batch_topk(docs, docs.limit(20).select(F.col("id").alias("query_id"), "vector"), 4).count() == 80


def test_hybrid_ties_of_rounding(spark):
    """Multiples of one vector have the same cosine but for its last digits: the smaller ids are the candidates."""
    rng = np.random.default_rng(3)
    x = rng.integers(1, 90, 16)
    docs = spark.createDataFrame([(i, [float(v) for v in x * (1 + i * 37 % 101)]) for i in range(100)], "id bigint, vector array<float>")
    texts = spark.createDataFrame([(i, "nothing") for i in range(100)], "id bigint, text string")
    q = spark.createDataFrame([(7, [float(v) for v in rng.integers(0, 3, 16)], "unknown")], "query_id bigint, vector array<float>, text string")
    got = retrieval.hybrid_search(docs, textindex.TextIndex(texts), q, 5, fusion.Rrf(60)).orderBy("rank").collect()
    assert [(r.id, round(r.combined_score, 8)) for r in got] == [(i, round(1 / (61 + i), 8)) for i in range(5)]
