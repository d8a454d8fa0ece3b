"""Retrieval-augmented answering with pluggable embedders and language models.

A model is anything that turns a prompt into a text. Providers for chat services
post JSON as those document it; offline there are `Echo`, which repeats what it
is asked, and `top_terms` for concepts.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.search import batch_topk, index_topk
from skein.operators.textindex import TextIndex, idf_weight, tf_weight
from skein.sources.embedders import Embedder, post_json

Llm = Callable[[str], str]
#: Default prompts; every function takes its own. ``{context}``, ``{question}`` and ``{text}`` are filled in.
PROMPT = "{context}\n---\n{question}\n"
CONCEPTS = "List up to three topics, one a line, under which to look for more about the question.\n\n{question}\n---\n{text}\n"
SNIPPET = 200


@dataclass
class Echo:
    """Offline: answers with the prompt."""

    def __call__(self, prompt: str) -> str:
        return prompt


@dataclass
class ChatModel:
    """A chat service: `style` is ``ollama`` or ``openai``."""

    style: str = "ollama"
    url: str = "http://localhost:11434"
    model: str = "llama3.2"
    key: str | None = None
    system_prompt: str = ""
    max_tokens: int = 1024
    temperature: float = 0.7
    top_p: float = 0.9

    def __call__(self, prompt: str) -> str:
        messages = [{"role": "system", "content": self.system_prompt}] if self.system_prompt else []
        messages.append({"role": "user", "content": prompt})
        body = {"model": self.model, "messages": messages}
        if self.style == "ollama":
            options = {"temperature": self.temperature, "top_p": self.top_p, "num_predict": self.max_tokens}
            return post_json(f"{self.url}/api/chat", body | {"stream": False, "options": options})["message"]["content"]
        choices = post_json(f"{self.url}/chat/completions", body | {"max_tokens": self.max_tokens, "temperature": self.temperature, "top_p": self.top_p}, self.key).get("choices") or []
        if not choices:
            raise ValueError("the service gave no answer")
        return choices[0]["message"]["content"]


def create_llm(name: str, **config) -> Llm:
    """A model by the provider's name; a missing key is taken from the environment."""
    if name == "echo":
        return Echo()
    if name == "ollama":
        return ChatModel("ollama", **config)
    if name == "openai":
        if "key" not in config:
            if "OPENAI_API_KEY" not in os.environ:
                raise ValueError("OPENAI_API_KEY is not set")
            config["key"] = os.environ["OPENAI_API_KEY"]
        return ChatModel("openai", **({"url": "https://api.openai.com/v1", "model": "gpt-4o-mini"} | config))
    raise ValueError(f"unknown language model provider {name!r}")


def snippet(text: str | None, size: int = SNIPPET) -> str:
    """The beginning of a text, with dots if it goes on."""
    text = text or ""
    return text if len(text) <= size else text[:size] + "..."


def pack_context(ranked: DataFrame, most_bytes: int = 8000, by: list[str] | None = None) -> DataFrame:
    """Rows ``(rank, score, text)`` with ``entry`` as long as all entries so far fit; the first that doesn't ends it."""
    entry = F.concat(F.format_string("[%d] (score=%.4f) ", F.col("rank").cast("int"), F.col("score")), F.coalesce("text", F.lit("")), F.lit("\n"))
    w = Window.partitionBy(*(by or [])).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("entry", entry).withColumn("used", F.sum(F.octet_length("entry")).over(w)).filter(F.col("used") <= most_bytes)


@dataclass
class Answer:
    answer: str
    sources: list[dict]
    timings: dict[str, float] = field(default_factory=dict)


def shown(tags: str = "tags"):
    """What stands for a record in a context: its text, or else its id and tags."""
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(F.col(tags), F.create_map().cast("map<string,string>")))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.coalesce(F.try_element_at(tags, F.lit("_text")), F.concat_ws(" ", F.col("id").cast("string"), F.array_join(pairs, " ")))


def answer(docs: DataFrame, question: str, embedder: Embedder, llm: Llm, top_k: int = 5, system_prompt: str = "", most_bytes: int = 8000, metric: str = "cosine", prompt: str = PROMPT) -> Answer:
    """Embed, search, pack the texts under ``tags['_text']`` and ask the model. `top_k` rows reach the driver.

    A record without a text is shown by its id and tags.
    """
    t = [time.time()]
    q = embedder.embed([question])[0]
    t.append(time.time())
    hits = index_topk(docs, q, top_k, metric, "hnsw").withColumn("text", shown())
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # top_k rows
    rows = pack_context(ranked, most_bytes).orderBy("rank").collect()
    t.append(time.time())
    filled = prompt.replace("{context}", "".join(r["entry"] for r in rows)).replace("{question}", question)
    said = llm((system_prompt + "\n\n" if system_prompt else "") + filled)
    t.append(time.time())
    names = ("embed_ms", "search_ms", "llm_ms")
    return Answer(said, [{"id": r["id"], "score": r["score"], "text": r["text"]} for r in rows], {n: 1000 * (b - a) for n, a, b in zip(names, t, t[1:])} | {"total_ms": 1000 * (t[-1] - t[0])})


def parse_concepts(said: str) -> list[str]:
    """Lines of a model's answer without bullets and numbers, those longer than two characters."""
    out = (re.sub(r"^[\s\-*•\d.)]+", "", x).strip() for x in said.splitlines())
    return [x for x in out if len(x) > 2]


def concepts_by(llm: Llm, question: str, prompt: str = CONCEPTS, most: int = 500) -> Callable[[str], list[str]]:
    """Concepts of a text for a question by a model, which sees the first `most` characters."""
    return lambda text: parse_concepts(llm(prompt.replace("{question}", question).replace("{text}", snippet(text, most))))


def top_terms(index: TextIndex, most: int = 3) -> DataFrame:
    """``(id, concepts)``: offline, the terms of a document with the greatest tf-idf weights, ties to the smaller term."""
    rows = index.with_df(index.postings).withColumn("w", tf_weight(F.col("tf")) * idf_weight(F.lit(index.doc_count()), F.col("df")))
    best = Window.partitionBy("id").orderBy(F.desc(F.round("w", 9)), "term")
    rows = rows.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most)
    return rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("concepts"))


def expand(docs: DataFrame, question: str, embedder: Embedder, concepts: Callable[[str], list[str]], seeds: int = 5, branch: int = 3, least: float = 0.3, depth: int = 3, most: int = 50) -> DataFrame:
    """Graph retrieval: seeds, then per node concepts, their neighbours, and so on.

    ``(id, score, depth, parent_id, concepts, text)``. Every depth is one batched
    search; at most `most` nodes exist in all, so the frontier fits the driver.
    """
    spark = docs.sparkSession
    first = index_topk(docs, embedder.embed([question])[0], seeds, "cosine", "hnsw").select("id", "score", shown().alias("text")).collect()
    nodes = {r["id"]: {"id": r["id"], "score": float(r["score"]), "depth": 0, "parent_id": None, "concepts": [], "text": r["text"] or ""} for r in first[:most]}
    frontier = list(nodes)
    for d in range(1, depth + 1):
        asked = []
        for i in frontier:
            if nodes[i]["score"] >= least:
                nodes[i]["concepts"] = concepts(nodes[i]["text"])[:3]
                asked += [(i, c) for c in nodes[i]["concepts"]]
        if not asked or len(nodes) >= most:
            break
        rows = [(f"{n}", v) for n, v in enumerate(embedder.embed([c for _, c in asked]))]
        q = spark.createDataFrame(rows, "query_id string, vector array<float>")
        hits = batch_topk(docs, q, branch).join(docs.select("id", shown().alias("text")), "id").orderBy(F.col("query_id").cast("int"), "rank").collect()
        frontier = []
        for r in hits:
            if r["id"] not in nodes and r["score"] >= least and len(nodes) < most:
                nodes[r["id"]] = {"id": r["id"], "score": float(r["score"]), "depth": d, "parent_id": asked[int(r["query_id"])][0], "concepts": [], "text": r["text"] or ""}
                frontier.append(r["id"])
        if not frontier:
            break
    return spark.createDataFrame([tuple(n.values()) for n in nodes.values()], "id string, score double, depth int, parent_id string, concepts array<string>, text string")


def synthesize(nodes: DataFrame, question: str, llm: Llm, top: int = 10, prompt: str = PROMPT) -> str:
    """An answer from the best `top` nodes, each with its score and how it was found."""
    rows = nodes.orderBy(F.desc("score"), "id").limit(top).collect()
    found = lambda r: f"expansion, depth {r['depth']}" if r["depth"] else "direct"
    context = "\n".join(f"[{n}] (score={r['score']:.4f}, {found(r)}) {snippet(r['text'])}" for n, r in enumerate(rows, 1))
    return llm(prompt.replace("{context}", context).replace("{question}", question))
