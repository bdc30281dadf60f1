"""Named queries: key -> (builder(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query builder; ``sql`` is its DuckDB oracle (None = rows-only check)."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from . import (  # noqa: F401
        candidate_queries,
        trace_queries,
        cases_queries,
        ranking_queries,
        similarity_queries,
        merge_queries,
        packing_queries,
        code_queries,
        lookup_queries,
        extract_queries,
        outcome_queries,
        result_queries,
    )
