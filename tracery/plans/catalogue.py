"""Every registered query of the library and its DuckDB counterpart."""

from __future__ import annotations

from . import coverage_queries, entry_queries, match_queries, sheet_queries, text_queries, trace_queries, verdict_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
