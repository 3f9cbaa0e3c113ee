"""Logical types: their Spark types, and the conversion of values and columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.errors import InvalidValue

Encode = Callable[[Any], Any]
Decode = Callable[[Column], Column]


@dataclass(frozen=True)
class LogicalType:
    """A named type: its Spark type, how a value is bound, and how a stored column is read."""

    name: str
    spark: str
    encode: Encode = lambda value: value
    decode: Decode = lambda column: column


def _formatted(pattern: str) -> Encode:
    def encode(value: Any) -> Any:
        if isinstance(value, (datetime, date, time)):
            return value.strftime(pattern)
        raise InvalidValue(f"expected a date or time, got {value!r}")

    return encode


def _boolean(value: Any) -> int:
    return int(bool(value))


def _array(value: Any) -> str | None:
    """Joined by commas without escaping; an empty list is stored as null."""
    return ",".join(map(str, value)) if value else None


def _guid(value: Any) -> str:
    text = str(value)
    if len(text) != 36:
        raise InvalidValue(f"a guid has 36 characters, got {len(text)}")
    return text


def _read_array(column: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(column.isNull() | (column == ""), empty).otherwise(F.split(column, ","))


def _read_json(column: Column) -> Column:
    """Null and empty text are null; other text that isn't JSON raises."""
    return F.parse_json(F.nullif(column, F.lit("")))


def _read_datetime(column: Column) -> Column:
    """The exact format first, then any text that reads as a timestamp; else an error."""
    exact = F.try_to_timestamp(column, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return F.when(exact.isNotNull(), exact).otherwise(column.cast("timestamp_ntz"))


_TYPES: dict[str, LogicalType] = {}


def add_type(kind: LogicalType) -> None:
    if kind.name in _TYPES:
        raise ValueError(f"type {kind.name} is registered already")
    _TYPES[kind.name] = kind


def override_type(kind: LogicalType) -> None:
    get_type(kind.name)
    _TYPES[kind.name] = kind


def get_type(name: str) -> LogicalType:
    if name not in _TYPES:
        raise InvalidValue(f"there is no type {name}")
    return _TYPES[name]


def type_names() -> list[str]:
    return sorted(_TYPES)


for _kind in (
    *(LogicalType(n, s, int, lambda c, s=s: c.cast(s)) for n, s in (("smallint", "smallint"), ("integer", "int"), ("bigint", "bigint"))),
    *(LogicalType(n, "decimal(10,0)", lambda v: Decimal(str(v)), lambda c: c.cast("string")) for n in ("decimal", "number")),
    LogicalType("float", "double", float, lambda c: c.cast("double")),
    LogicalType("smallfloat", "float", float, lambda c: c.cast("float")),
    *(LogicalType(n, "string", str) for n in ("string", "ascii_string", "text", "enum", "dateinterval")),
    LogicalType("guid", "string", _guid),
    *(LogicalType(n, "binary", lambda v: v.encode() if isinstance(v, str) else bytes(v), lambda c: c.cast("binary")) for n in ("binary", "blob")),
    LogicalType("boolean", "boolean", _boolean, lambda c: c.cast("boolean")),
    *(LogicalType(n, "date", _formatted("%Y-%m-%d"), lambda c: F.to_date(c.cast("string"), "yyyy-MM-dd")) for n in ("date", "date_immutable")),
    *(LogicalType(n, "timestamp_ntz", _formatted("%Y-%m-%d %H:%M:%S"), _read_datetime) for n in ("datetime", "datetime_immutable")),
    *(LogicalType(n, "timestamp", _formatted("%Y-%m-%d %H:%M:%S%z"), lambda c: F.to_timestamp(c, "yyyy-MM-dd HH:mm:ssXX")) for n in ("datetimetz", "datetimetz_immutable")),
    *(LogicalType(n, "string", _formatted("%H:%M:%S"), lambda c: F.date_format(F.to_timestamp(c, "HH:mm:ss"), "HH:mm:ss")) for n in ("time", "time_immutable")),
    *(LogicalType(n, "variant", json.dumps, _read_json) for n in ("json", "json_object", "jsonb", "jsonb_object")),
    LogicalType("simple_array", "string", _array, _read_array),
):
    add_type(_kind)

#: The logical name of a Spark type, by the start of its simple string.
LOGICAL_NAMES = {
    "tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "smallfloat", "double": "float", "decimal": "decimal",
    "string": "string", "varchar": "string", "char": "string", "binary": "binary", "boolean": "boolean", "date": "date", "timestamp_ntz": "datetime",
    "timestamp": "datetimetz", "time": "time", "variant": "json", "array": "json", "map": "json", "struct": "json", "interval": "dateinterval",
}


def logical_name(spark_type: str) -> str:
    """The logical type of a Spark type's simple string; an unknown one raises."""
    head = spark_type.partition("(")[0].partition("<")[0].split(" ")[0]
    if head not in LOGICAL_NAMES:
        raise InvalidValue(f"Spark type {spark_type} has no logical type")
    return LOGICAL_NAMES[head]


def spark_type(name: str, length: int | None = None, precision: int | None = None, scale: int | None = None, fixed: bool = False) -> str:
    """The Spark type of a logical type with its length, precision and scale.

    Strings with a length become varchar or, fixed, char; binary has no length in Spark.
    """
    kind = get_type(name).spark
    if kind.startswith("decimal"):
        return f"decimal({precision or 10},{scale or 0})"
    if name in ("string", "ascii_string") and length:
        return f"{'char' if fixed else 'varchar'}({length})"
    return kind


def bound(value: Any, name: str | None) -> Any:
    """The value to bind for a logical type; None stays None."""
    return value if value is None or name is None else get_type(name).encode(value)


def one_of(column: Column, values: list[str]) -> Column:
    """The column, with an error for values that an enumeration doesn't list."""
    if not values:
        raise InvalidValue("an enumeration needs values")
    fits = column.isNull() | column.isin(values)
    return F.when(fits, column).otherwise(F.raise_error(F.concat(F.lit("not in the enumeration: "), column)))
