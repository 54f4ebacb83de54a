"""Registry of queries: a Spark function and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six decimals under its own name."""
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double"), 6).alias(name or c)


def n(c: Column | str, name: str | None = None) -> Column:
    """A whole number as a long."""
    column = F.col(c) if isinstance(c, str) else c
    return column.cast("long").alias(name or c)
