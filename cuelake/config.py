"""Settings of the engine: a tree of frozen dataclasses with dotted-path overrides."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Chunking:
    strategy: str = "hybrid"  # hybrid, time or token
    duration: float = 300
    overlap: float = 30
    max_tokens: int = 462
    min_tokens: int = 50


@dataclass(frozen=True)
class Metadata:
    required: bool = False
    include_in_text: bool = False
    fields: tuple[str, ...] = ("title", "date", "description", "url")
    label: str = "Video metadata:"


@dataclass(frozen=True)
class Hybrid:
    enabled: bool = False
    method: str = "rrf"  # rrf or weighted
    bm25_weight: float = 0.3
    rrf_k: int = 60
    multiplier: int = 3


@dataclass(frozen=True)
class TwoStage:
    enabled: bool = False
    merge: str = "coverage"  # coverage or diverse_rrf
    merge_rrf_k: int = 60
    hyde_alpha: float = 0.5
    order: str = "rank"


@dataclass(frozen=True)
class Reranker:
    enabled: bool = False
    initial_k: int = 20
    least: float = 0.0


@dataclass(frozen=True)
class Config:
    top_k: int = 5
    chunking: Chunking = field(default_factory=Chunking)
    metadata: Metadata = field(default_factory=Metadata)
    hybrid: Hybrid = field(default_factory=Hybrid)
    two_stage: TwoStage = field(default_factory=TwoStage)
    reranker: Reranker = field(default_factory=Reranker)

    def override(self, **changes) -> Config:
        """A copy with dotted paths set, as in override(**{"hybrid.enabled": True})."""
        out = self
        for path, value in changes.items():
            head, _, rest = path.partition(".")
            out = dataclasses.replace(out, **{head: dataclasses.replace(getattr(out, head), **{rest: value}) if rest else value})
        return out
