"""The registered queries: name to function of (spark, directory), and name to SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, directory) under a name, with the SQL of the same result."""

    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap
