"""The register of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelake.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def query(*tables: str, sql: str | None = None):
    """Register a function as a query; sql continues a WITH of the adapters named in tables."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [getattr(A, t).strip() for t in tables]
            ORACLES[f.__name__] = ("WITH " + ",\n".join(parts) + ("," if sql.lstrip().startswith("WITH ") else "\n") + sql.lstrip().removeprefix("WITH ")) if parts else sql
        return f

    return add
