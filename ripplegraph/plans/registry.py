"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.plans.adapters import Relations, for_duckdb

Build = Callable[[Relations], DataFrame]
_QUERIES: dict[str, Build] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under its name, with the SQL that makes the same rows."""

    def add(build: Build) -> Build:
        _QUERIES[name] = build
        if sql:
            _SQL[name] = for_duckdb(sql)
        return build

    return add


def _load() -> None:
    from ripplegraph.plans import graph_queries, join_queries, scalar_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, build=build: build(Relations(spark, sf_dir))) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
