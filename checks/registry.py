"""Decorator that files a query and its SQL under one key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources.demo_tables import TXN_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        assert key not in QUERIES, key
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def txn_sql(select: str, *ctes: str) -> str:
    """SQL over the adapter view; further CTEs may refer to it."""
    return "with " + ",\n".join([TXN_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + select.strip()


def rounded(name: str | Column, digits: int = 9) -> Column:
    """Both engines compare doubles at a fixed number of digits; adding 0 drops the sign of zero."""
    column = F.col(name) if isinstance(name, str) else name
    result = F.round(column, digits) + F.lit(0.0)
    return result.alias(name) if isinstance(name, str) else result


def r(expression: str, name: str, digits: int = 9) -> str:
    """The same rounding in SQL."""
    return f"round({expression}, {digits}) + 0.0 as {name}"
