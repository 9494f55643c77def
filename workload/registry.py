"""The list of queries: name -> (Spark function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: QueryFunction) -> QueryFunction:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(value: str | Column) -> Column:
    """Doubles compare at six places: engines add in different orders."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6)
