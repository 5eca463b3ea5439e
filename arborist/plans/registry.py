"""The registered queries: a name, a function (spark, sf_dir) -> DataFrame, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import queries_admission, queries_evolution, queries_fits, queries_fitting, queries_more, queries_panels, queries_records, queries_relational, queries_scalar, queries_search, queries_solvers, queries_sources  # noqa: F401
