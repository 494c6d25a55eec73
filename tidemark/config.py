"""Settings with their defaults; every operator takes the ones it needs as arguments."""

from __future__ import annotations

from dataclasses import dataclass

OPERATIONAL = ("coding_style", "tool_preference", "behavioral_fact", "schedule", "other")
REFLECTIVE = ("confirmed_pattern", "value", "recurring_trigger", "helpful_strategy", "identity_hypothesis")
CATEGORIES = {"operational": OPERATIONAL, "reflective": REFLECTIVE}


@dataclass(frozen=True)
class Settings:
    decay_per_day: float = 0.01
    dedup_threshold: float = 0.80
    conflict_threshold: float = 0.75
    closed_penalty: float = 0.25
    window_turns: int = 12
    top_k: int = 5
    embedding_dim: int = 1536
    timezone: str = "America/New_York"
    min_session_turns: int = 6
    min_observations: int = 3
    min_dates: int = 2
    max_supporting: int = 10
    min_confidence: float = 0.6
    cache_threshold: float = 0.95
    cache_margin: float = 0.02


DEFAULTS = Settings()
