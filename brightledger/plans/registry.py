"""The registered queries and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries over fixed inputs, for the tests: not registered.
EXAMPLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the DuckDB SQL of the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def example(sql: str):
    """Keep a function of (spark, sf_dir) over fixed inputs, with the SQL of its rows, as an example that the tests run."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        EXAMPLES[f.__name__] = f, sql
        return f

    return keep
