"""Named queries over the tables, each with SQL that must agree with it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_PARTS: set[str] = set()


def query(sql: str | None = None, name: str | None = None, part: bool = False):
    """Enters a query with the SQL it must agree with; ``part`` if it answers for a subset of ids only."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise KeyError(key)
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        if part:
            _PARTS.add(key)
        return f

    return add


def _load() -> None:
    from . import covering, formats, graphs, joining, logbooks, profiling, searching, sourcetrees, sql_surface, versions, windowing  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def whole() -> tuple[dict[str, Query], dict[str, str]]:
    """The queries over whole tables, and their SQL; those of a part stay in the catalog for tests."""
    _load()
    return {k: v for k, v in _QUERIES.items() if k not in _PARTS}, {k: v for k, v in _SQL.items() if k not in _PARTS}
