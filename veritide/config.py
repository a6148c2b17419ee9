"""Engine settings and their limits."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Sizes and thresholds of the engine; checked when made."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    embedding_batch_size: int = 16
    vector_candidates: int = 20
    result_count: int = 5
    deduplication_threshold: float = 0.9
    source_diversity: bool = True
    entailment_threshold: float = 0.7
    contradiction_threshold: float = 0.7
    marker_mode: str = "compat"

    def __post_init__(self) -> None:
        for name in ("chunk_size", "embedding_batch_size", "vector_candidates", "result_count"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and smaller than chunk_size")
        if self.result_count > self.vector_candidates:
            raise ValueError("result_count cannot exceed vector_candidates")
        for name in ("deduplication_threshold", "entailment_threshold", "contradiction_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.marker_mode not in ("compat", "canonical"):
            raise ValueError("marker_mode must be compat or canonical")
