"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Queries whose rows come through Python workers; all others are planned without.
PYTHON: set[str] = set()


def query(name: str, oracle: str | None = None, python: bool = False) -> Callable[[Query], Query]:
    """Register a query, with DuckDB SQL for its rows where there is some; ``python`` marks those through Python workers."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        if python:
            PYTHON.add(name)
        return f

    return register
