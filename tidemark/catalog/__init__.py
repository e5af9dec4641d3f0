"""The engine's queries, by the id of what they show, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under name; sql gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


from tidemark.catalog import analytics, flow, order, siblings  # noqa: E402,F401
