"""Named queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = dedent(sql).strip()
        return f

    return add


def r4(x: str) -> str:
    """SQL of functions.numeric.rounded()."""
    return f"(floor(({x}) * 1e4 + 0.500001) / 1e4 + 0.0)"
