"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_folds, queries_lines, queries_metrics, queries_more, queries_policies, queries_repairs, queries_rules, queries_text, queries_time  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

FLAGSHIP = "session_blocks"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
