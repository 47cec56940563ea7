"""The named queries over the driver's tables, each with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def with_tables(parts: dict[str, str], names: list[str], body: str, recursive: bool = False) -> str:
    """A SELECT over named sub-tables, in dependency order."""
    head = ",\n".join(f"{n} AS ({parts[n].strip()})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body.strip()}"
