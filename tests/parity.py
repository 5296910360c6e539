"""Hold a query against its SQL in DuckDB, as sets of rows with columns in order of their names."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return found


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value


def rows_of(rows) -> Counter:
    return Counter(str([plain(x) for x in row]) for row in rows)


def assert_parity(df, sql: str, sf: str, db: duckdb.DuckDBPyConnection | None = None) -> None:
    db = db or database(sf)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = db.sql(f"SELECT {quoted} FROM ({sql})")
    assert sorted(expected.columns) == columns
    assert rows_of(df.select(*columns).collect()) == rows_of(expected.fetchall())
