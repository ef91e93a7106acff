"""The queries by name, each with its DataFrame form and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a SQL table of values."""
    say = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "[" + ", ".join(map(say, v)) + "]" if isinstance(v, list) else str(v)
    return f"(values {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) as c({columns})"
