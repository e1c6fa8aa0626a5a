"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from . import analyses, figures, histograms, joins, ordering, parsing, scalars, selections, storage, streams, tables  # noqa: F401

    return QUERIES, ORACLE
