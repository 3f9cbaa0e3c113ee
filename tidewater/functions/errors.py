"""Errors of the engine, and Spark's error conditions as such errors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException


class QueryError(Exception):
    """Anything that goes wrong while a query is built or run."""


class SyntaxErrorInQuery(QueryError):
    pass


class TableNotFound(QueryError):
    pass


class TableExists(QueryError):
    pass


class InvalidFieldName(QueryError):
    pass


class NonUniqueFieldName(QueryError):
    pass


class SchemaDoesNotExist(QueryError):
    pass


class MissingParameter(QueryError):
    pass


class NotSupported(QueryError):
    pass


class InvalidValue(QueryError):
    """A value that its logical type can't hold or read."""


#: Conditions, or their first part, and the errors that they stand for. Two conditions
#: share one SQLSTATE, so states aren't used.
CONDITIONS: dict[str, type[QueryError]] = {
    "PARSE_SYNTAX_ERROR": SyntaxErrorInQuery,
    "TABLE_OR_VIEW_NOT_FOUND": TableNotFound,
    "TABLE_OR_VIEW_ALREADY_EXISTS": TableExists,
    "UNRESOLVED_COLUMN": InvalidFieldName,
    "AMBIGUOUS_REFERENCE": NonUniqueFieldName,
    "SCHEMA_NOT_FOUND": SchemaDoesNotExist,
    "UNBOUND_SQL_PARAMETER": MissingParameter,
    "UNSUPPORTED_FEATURE": NotSupported,
}


@contextmanager
def converted() -> Iterator[None]:
    """Raise Spark's errors inside the block as the engine's, with the first as cause."""
    try:
        yield
    except PySparkException as error:
        condition = error.getCondition() or ""
        kind = CONDITIONS.get(condition) or CONDITIONS.get(condition.partition(".")[0], QueryError)
        raise kind(str(error).partition("\n")[0]) from error
