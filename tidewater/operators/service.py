"""A query service: capped results as JSON values, catalogue listings, no secrets."""

from __future__ import annotations

import base64
import math
import re
import time
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession

from tidewater.functions.errors import QueryError, converted
from tidewater.functions.params import Params, compile_sql
from tidewater.operators import result
from tidewater.sources import catalog

DEFAULT_ROWS, MOST_ROWS = 200, 1_000
_SAFE = 2**53 - 1
#: Credentials in urls; values of settings that name a secret, bare or quoted; bearer tokens.
_URL = re.compile(r"(?<=://)[^/@\s]+(?=@)")
_SETTING = re.compile(r"""((?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*)("[^"]*"|'[^']*'|[^\s&;,"']+)""", re.IGNORECASE)
_BEARER = re.compile(r"(bearer\s+)[\w.~+/-]+=*", re.IGNORECASE)


def redact(text: str, secrets: tuple[str, ...] = ()) -> str:
    """The text without the given secrets, longest first, and credentials in urls and settings."""
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        text = text.replace(secret, "***")
    return _BEARER.sub(r"\1***", _SETTING.sub(r"\1***", _URL.sub("***", text)))


def to_json(value: Any) -> Any:
    """A value that JSON can hold: large integers, decimals and odd floats as text."""
    if isinstance(value, dict):
        return {str(k): to_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return {"$binary": True, "base64": base64.b64encode(bytes(value)).decode()}
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value if abs(value) <= _SAFE else str(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    return str(value) if isinstance(value, Decimal) else str(value)


def execute(spark: SparkSession, sql: str, params: Params = (), max_rows: int = DEFAULT_ROWS, secrets: tuple[str, ...] = ()) -> dict[str, Any]:
    """Rows up to the cap and whether there were more; one row over the cap is computed.

    row_count is the number of rows seen, the cap and one at most: counting the rest
    would run all of the query. Errors of any kind are raised without secrets.
    """
    cap, began = max(1, min(MOST_ROWS, max_rows)), time.perf_counter()
    try:
        text, args = compile_sql(sql, params)
        with converted():
            df = spark.sql(text, args=args)
            rows = result.fetch_all_associative(df.limit(cap + 1))
    except QueryError as error:
        raise type(error)(redact(str(error), secrets)) from None
    except Exception as error:
        raise QueryError(redact(str(error).strip() or "unknown error", secrets)) from None
    return {
        "columns": df.columns,
        "rows": [to_json(r) for r in rows[:cap]],
        "row_count": len(rows),
        "returned_row_count": min(len(rows), cap),
        "truncated": len(rows) > cap,
        "duration_ms": round((time.perf_counter() - began) * 1000, 3),
    }


def info(spark: SparkSession) -> dict[str, str]:
    return {"engine": "spark", "version": spark.version, "schema": spark.sql("SELECT current_schema()").first()[0]}


def tables(spark: SparkSession) -> list[str]:
    return catalog.list_tables(spark)


def views(spark: SparkSession) -> list[str]:
    return catalog.list_views(spark)


def schemas(spark: SparkSession) -> list[str]:
    return catalog.list_schemas(spark)


def describe(spark: SparkSession, table: str) -> list[dict[str, Any]]:
    return result.fetch_all_associative(catalog.describe(spark, table).orderBy("position"))
