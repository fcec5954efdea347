"""The registry of queries: each has a name, a function of (spark, sf_dir) and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from barlume.plans import bar_queries, flow_queries, model_queries, regime_queries, risk_queries, store_queries  # noqa: F401  they register themselves

    return dict(QUERIES), dict(SQL)
