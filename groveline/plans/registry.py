"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that DuckDB answers with the same rows."""

    def wrap(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return wrap


def own_sql() -> dict[str, str]:
    """The SQL registered so far, for queries built from others."""
    return _ORACLE


def _load() -> None:
    from groveline.plans import catalogue  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
