"""Queries of the library with their DuckDB counterparts; modules add to it as they are imported."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that register queries.
MODULES: tuple[str, ...] = ("plans.corpus", "plans.lexicon", "plans.lookups", "plans.files", "plans.audit", "plans.store", "plans.exports", "plans.commands", "plans.scans")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL that DuckDB runs for the same rows where there is one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"lexispark.{module}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
