"""The registry of queries: (name, Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator that records a query and, where there is one, its SQL."""

    def keep(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return keep


def _load() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(f"lodestone.plans.{module}")


#: Modules of this package that register queries when they are imported.
MODULES: tuple[str, ...] = ("search", "graphs", "metrics", "edges", "analysis", "units", "code_search", "upkeep", "front", "sources")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top hits of the scored search; see ``plans.search``."""
    return queries()["se01_scored_search"](spark, sf_dir)
