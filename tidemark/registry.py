"""Registered queries and the SQL that states the same result for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries when imported.
MODULES = ("plans.data", "plans.features", "plans.trading", "plans.setups", "plans.statistics", "plans.streams", "plans.roundtrips")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: register a (spark, sf_dir) -> DataFrame function under a name, with its SQL if that can state it."""

    def add(function):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = function
        if sql is not None:
            _sql[name] = sql
        return function

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemark.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
