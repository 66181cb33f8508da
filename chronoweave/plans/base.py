"""Registering a query with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..notes import notes_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The canonical interval table with users as tracks, and with users folded into eight.
N, N8 = notes_sql(), notes_sql(8)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``sql`` may use {N} and {N8} for the interval table."""

    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.replace("{N8}", N8).replace("{N}", N)
        return fn

    return put


def also(name: str, other: str) -> None:
    """Registers the query ``name``, and its SQL, under ``other`` too."""
    QUERIES[other] = QUERIES[name]
    if name in ORACLES:
        ORACLES[other] = ORACLES[name]
