"""Engine settings as one value, passed explicitly; the environment may override three of them."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from datetime import UTC, datetime


@dataclass(frozen=True)
class EngineConfig:
    top_k: int = 3
    scored_k: int = 5
    rerank: bool = True
    rerank_candidates: int = 20
    recital_penalty: float = 3.0
    strategy: str = "hybrid"
    rrf_constant: int = 60
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    shingle: int = 12
    provisions_shown: int = 8
    chunk_words: int = 500
    chunk_overlap: int = 50
    page_chars: int = 50
    page_share: float = 0.8
    embed_chars: int = 32_000
    embed_batch: int = 100
    dev_ratio: float = 0.7
    seed: int = 42
    corpus: str = "v2"

    @staticmethod
    def from_env() -> EngineConfig:
        c = EngineConfig()
        env = os.environ
        if "RAG_RERANK_CANDIDATES" in env:
            c = replace(c, rerank_candidates=int(env["RAG_RERANK_CANDIDATES"]))
        if "RAG_RECITAL_PENALTY" in env:
            c = replace(c, recital_penalty=float(env["RAG_RECITAL_PENALTY"]))
        return replace(c, corpus=env["RAG_CORPUS_VERSION"]) if "RAG_CORPUS_VERSION" in env else c

    @property
    def expanded_k(self) -> int:
        """Candidates that each retriever gives to the fusion."""
        return max(3 * self.pool, 20)

    @property
    def pool(self) -> int:
        return max(self.top_k, self.rerank_candidates) if self.rerank else self.top_k


def run_id(now: datetime | None = None) -> str:
    """UTC time as an ingestion run's name."""
    return (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
