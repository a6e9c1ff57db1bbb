"""The registered queries: name -> callable, and name -> SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: queries whose result no SQL can state
_MEASURED: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL where there is one."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def measured(name: str) -> Callable[[Query], Query]:
    """Registers a query without SQL; tests hold it against a plain calculation."""

    def add(fn: Query) -> Query:
        if name in _QUERIES or name in _MEASURED:
            raise ValueError(f"query {name} is registered twice")
        _MEASURED[name] = fn
        return fn

    return add


def _load() -> None:
    from . import catalog  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def measured_queries() -> dict[str, Query]:
    _load()
    return dict(_MEASURED)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
