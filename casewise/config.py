"""Prediction settings shared by every model."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Reserved activities and default settings.
START = "__start__"
STOP = "__stop__"
EMPTY = "__empty__"


@dataclass(frozen=True)
class Config:
    """Immutable settings; unknown names are rejected by :meth:`of`."""

    start_symbol: str = START
    stop_symbol: str = STOP
    empty_symbol: str = EMPTY
    discount_factor: float = 0.9
    randomized: bool = False
    top_k: int = 3
    include_stop: bool = True
    include_time: bool = True
    maxlen_delays: int = 50

    @classmethod
    def of(cls, **values) -> Config:
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(unknown)}")
        return replace(cls(), **values)
