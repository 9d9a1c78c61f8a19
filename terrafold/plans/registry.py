"""Collects the registered territory queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrafold.session import with_checkpoints

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory ids; ``sql`` is DuckDB's text for the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(with_checkpoints(spark), sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from . import areas, files, places, scalars, tables, workspace  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg8_agg9_rollup"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
