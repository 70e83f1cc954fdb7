"""Schemas and settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass

DOCUMENT = "doc_id string, text string"
CHUNK = "chunk_id string, doc_id string, text string, ordinal int, heading string, meta map<string,string>"
SPAN = "ordinal int, start int, end int, heading string, text string"
HIT = "query_id string, source string, rank int, chunk_id string, score double"
CASE = "question string, relevant_docs array<string>, expected_route string"


@dataclass(frozen=True)
class Settings:
    """What the engine can be told; the defaults are those that published figures rest on."""

    chunk_size: int = 800
    overlap: int = 120
    top_k: int = 6
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    dim: int = 512
    guard_alpha: float = 0.5
    spearman_floor: float = 0.2
    rerank: bool = True
    rerank_cut: int = 10
    grounding_floor: float = 0.18
    max_expansions: int = 12
    max_steps: int = 6
    min_overlap: float = 0.28
    deterministic: bool = True

    @classmethod
    def from_conf(cls, spark, prefix: str = "spark.gristmill.") -> Settings:
        """Defaults overridden by session settings; a value that can't be read as the default's type is passed over."""
        found = {}
        for name, kind in cls.__annotations__.items():
            raw = spark.conf.get(prefix + name, None)
            if raw is None:
                continue
            try:
                found[name] = raw.lower() in ("1", "true", "yes", "on") if kind == "bool" else {"int": int, "float": float}[kind](raw)
            except ValueError:
                continue
        return cls(**found)
