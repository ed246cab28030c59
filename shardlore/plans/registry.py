"""Registration of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardlore.plans import domain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Register a function under its name; sql continues the domain views' WITH clause, or stands alone."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            text = sql.strip()
            if views:
                text = domain.SQL.strip().replace("WITH", "WITH RECURSIVE", 1) + (", " + text[5:] if text.upper().startswith("WITH ") else " " + text)
            SQL[function.__name__] = text
        return function

    return add
