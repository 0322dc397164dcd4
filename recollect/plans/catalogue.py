"""All queries of the engine."""

from __future__ import annotations

from recollect.plans import claims, envelope, graphs, memory, quality, search, texts, upkeep
from recollect.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "claims", "envelope", "graphs", "memory", "quality", "search", "texts", "upkeep"]
