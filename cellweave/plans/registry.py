"""Registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views as a query, with the SQL of the same result."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
