"""All registered queries but those of the corpus operators."""

from __future__ import annotations

from shiftlens.plans import diff_queries, graph_queries, ingest_queries, metrics_queries  # noqa: F401
from shiftlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
