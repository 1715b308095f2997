"""Settings with the defaults of a retrieval service; each may come from the environment as TEXTLOOM_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 350
    chunk_overlap: int = 50
    min_chunk_size: int = 200
    max_chunk_size: int = 800
    chunking_strategy: str = "section_aware"
    top_k: int = 10
    embedding_dim: int = 64
    context_chars: int = 4000
    context_hits: int = 5

    @classmethod
    def from_env(cls) -> Settings:
        found = {f.name: os.environ.get(f"TEXTLOOM_{f.name.upper()}") for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in found.items() if v is not None})
