"""Embedding providers: an Arrow-batch source behind a small protocol.

The HTTP providers post JSON as the public services document it; without a
network only the deterministic offline provider can run.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def post_json(url: str, body: dict, key: str | None = None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=60) as r:
        return json.load(r)


@dataclass
class HashEmbedder:
    """Offline: signed feature hashing of words, scaled to length 1; an empty text gives zeros."""

    dimension: int = 384

    def embed(self, texts):
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
            n = np.sqrt((out[i] ** 2).sum())
            out[i] /= n or 1
        return out.tolist()


@dataclass
class OllamaEmbedder:
    url: str = "http://localhost:11434"
    model: str = "nomic-embed-text"
    dimension: int = 768

    def embed(self, texts):
        return post_json(f"{self.url}/api/embed", {"model": self.model, "input": texts})["embeddings"]


@dataclass
class OpenAiEmbedder:
    key: str
    url: str = "https://api.openai.com/v1"
    model: str = "text-embedding-3-small"
    dimension: int = 1536

    def embed(self, texts):
        return [d["embedding"] for d in sorted(post_json(f"{self.url}/embeddings", {"model": self.model, "input": texts}, self.key)["data"], key=lambda d: d["index"])]


@dataclass
class HuggingFaceEmbedder:
    key: str
    url: str = "https://api-inference.huggingface.co"
    model: str = "sentence-transformers/all-MiniLM-L6-v2"
    dimension: int = 384

    def embed(self, texts):
        return post_json(f"{self.url}/pipeline/feature-extraction/{self.model}", {"inputs": texts}, self.key)


@dataclass
class CohereEmbedder:
    key: str
    url: str = "https://api.cohere.ai"
    model: str = "embed-english-v3.0"
    dimension: int = 1024

    def embed(self, texts):
        return post_json(f"{self.url}/v1/embed", {"model": self.model, "texts": texts, "input_type": "search_document"}, self.key)["embeddings"]


REGISTRY = {"hash": (HashEmbedder, None), "ollama": (OllamaEmbedder, None), "openai": (OpenAiEmbedder, "OPENAI_API_KEY"), "huggingface": (HuggingFaceEmbedder, "HUGGINGFACE_API_KEY"), "cohere": (CohereEmbedder, "COHERE_API_KEY")}


def create(name: str, **config) -> Embedder:
    """A provider by name; a missing key is taken from its environment variable."""
    if name not in REGISTRY:
        raise ValueError(f"unknown embedding provider {name!r}")
    kind, env = REGISTRY[name]
    if env and "key" not in config:
        if env not in os.environ:
            raise ValueError(f"{env} is not set")
        config["key"] = os.environ[env]
    return kind(**config)


def embed(docs: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector", batch: int = 256) -> DataFrame:
    """`docs` with the vector of `text`; a null text gives a null vector."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                s = b.slice(at, batch)
                texts = s.column(text).to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None]
                vectors: list = [None] * len(texts)
                for i, v in zip(known, embedder.embed([texts[i] for i in known]) if known else []):
                    vectors[i] = v
                keep = [c for c in s.schema.names if c != out]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(vectors, pa.list_(pa.float32()))], names=[*keep, out])

    return docs.mapInArrow(run, schema)


def text_records(docs: DataFrame, embedder: Embedder) -> DataFrame:
    """``(id, vector, tags)`` of texts; the text is kept under the tag ``_text``, replacing one of that name."""
    rows = docs if "tags" in docs.columns else docs.withColumn("tags", F.create_map().cast("map<string,string>"))
    rest = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: k != "_text")
    return embed(rows.filter("text IS NOT NULL"), embedder).select("id", "vector", F.map_concat(rest, F.create_map(F.lit("_text"), "text")).alias("tags"))
