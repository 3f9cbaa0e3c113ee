"""Compares a registered query with its DuckDB SQL, as multisets of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return value if value is None else str(value)


def assert_same(df, sql: str, folder: str) -> int:
    found = connect(folder).execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=str)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in found.fetchall()), key=str)
    assert ours == theirs
    return len(ours)
