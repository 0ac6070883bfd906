"""Settings: defaults, merge and validation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace


class EngineError(Exception):
    """An error with a code and what can be done about it."""

    def __init__(self, code: str, message: str, hint: str = ""):
        super().__init__(f"{code}: {message}")
        self.code, self.hint = code, hint


@dataclass(frozen=True)
class Settings:
    chunk_lines: int = 50
    dimension: int = 64
    limit: int = 10
    min_score: float = 0.0
    token_budget: int = 100_000
    daily_units: int = 10_000
    weights: dict[str, float] = field(default_factory=lambda: {"semantic": 0.40, "proximity": 0.20, "symbol": 0.25, "recency": 0.10, "frequency": 0.05})


def merged(base: Settings, changes: dict) -> Settings:
    """``base`` with changes; unknown names and wrong values raise."""
    unknown = set(changes) - set(asdict(base))
    if unknown:
        raise EngineError("CONFIG", f"unknown settings {sorted(unknown)}")
    out = replace(base, **changes)
    if abs(sum(out.weights.values()) - 1) > 0.01:
        raise EngineError("CONFIG", "weights must sum to 1", "scale them")
    if min(out.chunk_lines, out.dimension, out.limit, out.token_budget) <= 0:
        raise EngineError("CONFIG", "sizes and limits must be positive")
    return out
