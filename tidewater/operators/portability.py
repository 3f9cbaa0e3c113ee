"""Normalisation of results that come from different stores, as column expressions."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class Portability(IntFlag):
    """What is normalised; RTRIM, EMPTY_TO_NULL and FIX_CASE combine."""

    RTRIM = 1
    EMPTY_TO_NULL = 4
    FIX_CASE = 8
    ALL = 255


#: White space at the end of a string.
TRAILING_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+\z"


def empty_to_null(column: Column) -> Column:
    return F.when(column != "", column)


def right_trim(column: Column) -> Column:
    return F.regexp_replace(column, TRAILING_SPACE, "")


def normalise(df: DataFrame, flags: Portability = Portability.ALL, upper: bool = False) -> DataFrame:
    """Apply the flags to all string columns and names.

    Emptiness is tested before trimming: a string of spaces becomes empty, not null.
    """
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            column = empty_to_null(column) if flags & Portability.EMPTY_TO_NULL else column
            column = right_trim(column) if flags & Portability.RTRIM else column
        name = field.name
        if flags & Portability.FIX_CASE:
            name = name.upper() if upper else name.lower()
        columns.append(column.alias(name))
    return df.select(*columns)
