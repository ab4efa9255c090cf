"""All queries of the engine's own operators, by name, with the SQL that DuckDB runs beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query function under its name, with its SQL for the oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


from millrace.plans import benchmarks, core, etl, functions, semantics  # noqa: E402  they register their queries here

__all__ = ["ORACLE_SQL", "QUERIES", "benchmarks", "core", "etl", "functions", "query", "semantics"]
