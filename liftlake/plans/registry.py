"""Query registry: a name, a Spark plan over the table folder, and its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` is the equivalent DuckDB statement, if there is one."""

    def add(fn: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query '{name}' registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every query module (idempotent)."""
    from liftlake.plans import (  # noqa: F401
        catalog_queries,
        corpus_queries,
        decision_queries,
        effect_queries,
        evaluation_queries,
        funnel_queries,
        history_queries,
        segment_queries,
        validity_queries,
    )
