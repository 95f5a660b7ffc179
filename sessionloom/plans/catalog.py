"""The list of queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def enter(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is listed twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return enter


def load() -> None:
    """Import the modules that list queries."""
    from . import (  # noqa: F401
        queries_exchange,
        queries_ingest,
        queries_loops,
        queries_responses,
        queries_serving,
        queries_sources,
        queries_state,
        queries_streams,
        queries_traces,
    )
