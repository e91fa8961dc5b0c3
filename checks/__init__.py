"""Registered queries, each next to the SQL that DuckDB runs on the same tables."""

from checks.registry import ORACLES, QUERIES
from checks import (  # noqa: F401  (importing registers the queries)
    case_checks,
    history_checks,
    learning_checks,
    model_checks,
    row_checks,
    state_checks,
    stream_checks,
    table_checks,
)

__all__ = ["ORACLES", "QUERIES"]
