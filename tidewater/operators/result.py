"""Access to results: rows as dicts or tuples, first columns, key and value pairs.

The fetch functions bring whole results to the driver; the iterate functions bring
one partition at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row

from tidewater.functions.errors import QueryError


def _dict(row: Row, names: list[str]) -> dict[str, Any]:
    """Of columns with the same name the last one counts."""
    return dict(zip(names, row, strict=True))


def fetch_associative(df: DataFrame) -> dict[str, Any] | None:
    row = df.first()
    return None if row is None else _dict(row, df.columns)


def fetch_numeric(df: DataFrame) -> tuple[Any, ...] | None:
    row = df.first()
    return None if row is None else tuple(row)


def fetch_one(df: DataFrame) -> Any:
    row = df.first()
    return None if row is None else row[0]


def fetch_all_associative(df: DataFrame) -> list[dict[str, Any]]:
    return [_dict(r, df.columns) for r in df.collect()]


def fetch_all_numeric(df: DataFrame) -> list[tuple[Any, ...]]:
    return [tuple(r) for r in df.collect()]


def fetch_first_column(df: DataFrame) -> list[Any]:
    return [r[0] for r in df.select(df[df.columns[0]]).collect()] if len(set(df.columns)) == len(df.columns) else [r[0] for r in df.collect()]


def _need_two(df: DataFrame) -> None:
    if len(df.columns) < 2:
        raise QueryError("key and value need two columns at least")


def fetch_all_key_value(df: DataFrame) -> dict[str, Any]:
    """First column as text to second column; of equal keys the last counts."""
    _need_two(df)
    return {str(r[0]): r[1] for r in df.collect()}


def fetch_all_associative_indexed(df: DataFrame) -> dict[str, dict[str, Any]]:
    """First column as text to a dict of the other columns."""
    return {str(r[0]): dict(zip(df.columns[1:], r[1:], strict=True)) for r in df.collect()}


def iterate_associative(df: DataFrame) -> Iterator[dict[str, Any]]:
    return (_dict(r, df.columns) for r in df.toLocalIterator())


def iterate_numeric(df: DataFrame) -> Iterator[tuple[Any, ...]]:
    return (tuple(r) for r in df.toLocalIterator())


def iterate_column(df: DataFrame) -> Iterator[Any]:
    return (r[0] for r in df.toLocalIterator())


def iterate_key_value(df: DataFrame) -> Iterator[tuple[Any, Any]]:
    _need_two(df)
    return ((r[0], r[1]) for r in df.toLocalIterator())


def iterate_associative_indexed(df: DataFrame) -> Iterator[tuple[Any, dict[str, Any]]]:
    return ((r[0], dict(zip(df.columns[1:], r[1:], strict=True))) for r in df.toLocalIterator())


def row_count(df: DataFrame) -> int:
    return df.count()


def column_count(df: DataFrame) -> int:
    return len(df.columns)


def column_name(df: DataFrame, index: int) -> str:
    if not 0 <= index < len(df.columns):
        raise QueryError(f"there is no column {index}; there are {len(df.columns)}")
    return df.columns[index]
