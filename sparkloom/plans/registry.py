"""Queries register themselves here with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name. ``base`` holds common table expressions that ``sql`` may use."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {base} {sql}" if base else sql
        return f

    return keep
