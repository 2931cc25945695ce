"""Registered queries: one per operator, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def keep(query: Query) -> Query:
        _queries[query.__name__] = query
        if sql is not None:
            _sql[query.__name__] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every module of queries, in inventory order."""
    from workload import (  # noqa: F401
        sources,
        filters,
        joins,
        aggregates,
        sorts,
        setops,
        scalars,
        search,
        increments,
        checks,
    )

    return dict(_queries), dict(_sql)
