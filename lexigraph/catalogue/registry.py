"""The registry that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Checks of functions that read no table: run by the tests, registered nowhere.
FIXED: dict[str, tuple[Query, str]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with SQL for the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def fixed(sql: str) -> Callable[[Query], Query]:
    """Keeps a check of constants, with SQL for the same rows."""

    def keep(f: Query) -> Query:
        FIXED[f.__name__] = (f, sql)
        return f

    return keep
