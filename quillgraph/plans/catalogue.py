"""Every registered query of the graph engine with its SQL twin."""

from __future__ import annotations

from . import aggregate_queries, fact_queries, graph_queries, link_queries, resolve_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "aggregate_queries", "fact_queries", "graph_queries", "link_queries", "resolve_queries"]
