"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB SQL where there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def r6(value: str | Column, digits: int = 6) -> Column:
    """Rounded so that sums in another order compare equal; a plain column keeps its name."""
    rounded = F.round(F.col(value) if isinstance(value, str) else value, digits)
    return rounded.alias(value) if isinstance(value, str) else rounded
