"""Run settings: one frozen dataclass, checked when it is built."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pagewright import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    provider: str = "offline"
    model: str = "offline-extract"
    fallback_models: str = ""
    temperature: float = 0.3
    max_tokens: int = 2048
    timeout_seconds: float = 30.0
    top_k: int = 10
    max_distance: float = 1.1
    chunk_size: int = 700
    chunk_overlap: int = 100
    session_max_turns: int = 6
    admin_user_ids: str = ""

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k must be between 1 and 20")
        if self.max_distance <= 0:
            raise ValueError("max_distance must be positive")
        if self.chunk_size < 200:
            raise ValueError("chunk_size must be at least 200")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be non-negative and smaller than chunk_size")
        if self.session_max_turns < 1:
            raise ValueError("session_max_turns must be at least 1")

    @property
    def history_messages(self) -> int:
        return self.session_max_turns * fv.MESSAGES_PER_TURN

    @classmethod
    def from_env(cls, prefix: str = "PAGEWRIGHT_") -> "Settings":
        """Read overrides such as ``PAGEWRIGHT_TOP_K=5``; unknown names are ignored."""
        given = {}
        for field in fields(cls):
            raw = os.environ.get(prefix + field.name.upper())
            if raw is not None:
                given[field.name] = type(field.default)(raw)
        return cls(**given)
