"""Columns of SQL text: one-line form, tokens and parameters, by Spark's own functions.

For query logs: every function takes a string column and stays inside Spark's
expressions, so a log of any size is a plain scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`"
_COMMENT = r"--[^\n]*|#[^\n]*|/\*(?s:.*?)\*/"
TOKEN = rf"{_STRING}|{_COMMENT}|[A-Za-z_][\w$.]*|[0-9]+(?:\.[0-9]+)?|::|<>|<=|>=|!=|[^\s]"
#: From the end of the last match on: anything but gaps, then a gap.
_UP_TO_GAP = rf"\G((?:{_STRING}|-(?!-)|/(?!\*)|[^\s'\"`#/-])*+)(?:\s|{_COMMENT})+"


def tokens(sql: Column) -> Column:
    """All tokens in order, without white space and comments; null for null."""
    found = F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.rlike(rf"^(?:{_COMMENT})$"))


def compress(sql: Column) -> Column:
    """Comments dropped, white space outside strings as one space."""
    return F.trim(F.regexp_replace(sql, _UP_TO_GAP, "$1 "))


def shape(sql: Column) -> Column:
    """The statement with every literal as `?` and in upper case, to group a query log by."""
    literal = r"^(?:'(?s:.*)'|[0-9]+(?:\.[0-9]+)?)$"
    return F.array_join(F.transform(tokens(sql), lambda t: F.when(t.rlike(literal), F.lit("?")).otherwise(F.upper(t))), " ")
