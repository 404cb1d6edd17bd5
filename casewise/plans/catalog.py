"""All named queries."""

from __future__ import annotations

from casewise.plans import comparison, description, learning, preparation, replay, streams, voting  # noqa: F401
from casewise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
