"""Every query by name, with its SQL twin."""

from __future__ import annotations

from . import feature_queries, graph_queries, match_queries, report_queries, store_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "feature_queries", "graph_queries", "match_queries", "report_queries", "store_queries"]
