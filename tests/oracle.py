"""Runs a query and its SQL and compares them as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if not x.is_integer() else str(int(x))
    if isinstance(x, bool) or x is None:
        return str(x)
    return str(x)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, db, query, sql: str, sf_dir: str) -> str:
    """Nothing if they agree, else what differs."""
    got = query(spark, sf_dir)
    rel = db.execute(sql)
    columns = [c[0] for c in rel.description]
    expected = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} against {sorted(columns)}"
    actual = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if actual == expected:
        return ""
    extra = [r for r in actual if r not in set(expected)][:3]
    missing = [r for r in expected if r not in set(actual)][:3]
    return f"{len(actual)} rows against {len(expected)}; extra {extra}; missing {missing}"
