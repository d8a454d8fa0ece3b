"""Settings of an engine in one place, checked when they are given."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession

from skein.errors import DatabaseError
from skein.operators import rag
from skein.operators.stored import KINDS
from skein.sources import embedders
from skein.sources.collection import Collection


@dataclass(frozen=True)
class EngineConfig:
    """Where collections live, which index and metric they take, and which providers serve them."""

    path: str
    dimension: int | None = None
    algorithm: str = "hnsw"
    metric: str = "euclidean"
    links: int = 16
    search_ef: int = 64
    nlist: int = 256
    nprobe: int = 16
    subspaces: int = 8
    codes: int = 256
    hashes: int = 10
    embedder: str = "hash"
    embedder_options: dict = field(default_factory=dict)
    llm: str = "echo"
    llm_options: dict = field(default_factory=dict)
    max_chunk_size: int = 1000
    overlap_size: int = 100

    def __post_init__(self):
        if self.algorithm not in (*KINDS, "exact"):
            raise DatabaseError(f"unknown algorithm {self.algorithm!r}")
        if self.metric not in ("euclidean", "cosine", "dot"):
            raise DatabaseError(f"unknown metric {self.metric!r}")
        for f in fields(self):
            if f.type == "int" and getattr(self, f.name) < (0 if f.name == "overlap_size" else 1):
                raise ValueError(f"{f.name} is too small")
        if self.overlap_size >= self.max_chunk_size:
            raise ValueError("the overlap must be smaller than the size")

    @classmethod
    def of(cls, settings: dict) -> EngineConfig:
        """From a mapping; an unknown name raises."""
        unknown = set(settings) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**settings)

    def as_dict(self) -> dict:
        return asdict(self)

    def collection(self, spark: SparkSession, name: str = "vectors") -> Collection:
        return Collection(spark, f"{self.path.rstrip('/')}/{name}", self.dimension, "exact" if self.algorithm == "linear" else self.algorithm, self.metric)

    def build_index(self, spark: SparkSession, name: str = "vectors"):
        return self.collection(spark, name).build_index(links=self.links, nlist=self.nlist, m=self.subspaces, codes=self.codes, hashes=self.hashes)

    def make_embedder(self) -> embedders.Embedder:
        return embedders.create(self.embedder, **self.embedder_options)

    def make_llm(self) -> rag.Llm:
        return rag.create_llm(self.llm, **self.llm_options)
