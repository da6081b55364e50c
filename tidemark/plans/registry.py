"""Registered queries of the entity-and-period operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "p01_rolling_form"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from tidemark.plans import contract_queries, event_queries, feature_queries, game_queries, learned_queries, lineage_queries, more_queries, readiness_queries, relational_queries, rolling_queries, rule_queries, similarity_queries, stored_queries, summary_queries, window_queries  # noqa: F401
