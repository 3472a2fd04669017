"""Composed analyses and the registry of queries."""

from . import graph_queries, risk_queries, source_queries, text_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
