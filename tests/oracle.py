"""Comparison of a Spark query with its DuckDB twin."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with the given tables as views."""
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def shown(x) -> str:
    """A value as text, doubles and decimals to six digits."""
    if x is None:
        return ""
    if isinstance(x, (bool, int, str)):
        return str(x)
    return f"{float(x) + 0.0:.6f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


def same(frame, relation) -> None:
    """Equal column names and equal rows in any order."""
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    got = sorted(tuple(shown(row[c]) for c in columns) for row in frame.collect())
    names = relation.columns
    expected = sorted(tuple(shown(dict(zip(names, row, strict=True))[c]) for c in columns) for row in relation.fetchall())
    assert got == expected
