"""Predicates and scalar functions as Spark SQL text, for builder slots and F.expr."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal

from tidewater.functions.errors import NotSupported


def quote_identifier(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def quote_string(text: str) -> str:
    """A string literal; Spark reads backslashes in literals, so they are doubled."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Composite:
    """Predicates joined by AND or OR; a single one stands by itself."""

    kind: str
    parts: tuple[str, ...]

    def with_(self, *parts: object) -> Composite:
        return Composite(self.kind, (*self.parts, *map(str, parts)))

    def __len__(self) -> int:
        return len(self.parts)

    def __str__(self) -> str:
        return self.parts[0] if len(self.parts) == 1 else "(" + f") {self.kind} (".join(self.parts) + ")"


def and_(first: object, *more: object) -> Composite:
    return Composite("AND", tuple(map(str, (first, *more))))


def or_(first: object, *more: object) -> Composite:
    return Composite("OR", tuple(map(str, (first, *more))))


def comparison(x: object, operator: str, y: object) -> str:
    return f"{x} {operator} {y}"


def eq(x: object, y: object) -> str:
    return comparison(x, "=", y)


def neq(x: object, y: object) -> str:
    return comparison(x, "<>", y)


def lt(x: object, y: object) -> str:
    return comparison(x, "<", y)


def lte(x: object, y: object) -> str:
    return comparison(x, "<=", y)


def gt(x: object, y: object) -> str:
    return comparison(x, ">", y)


def gte(x: object, y: object) -> str:
    return comparison(x, ">=", y)


def is_null(x: object) -> str:
    return f"{x} IS NULL"


def is_not_null(x: object) -> str:
    return f"{x} IS NOT NULL"


def _escape(character: str | None) -> str:
    return "" if character is None else f" ESCAPE {quote_string(character)}"


def like(x: object, pattern: object, escape: str | None = None) -> str:
    return f"{x} LIKE {pattern}{_escape(escape)}"


def not_like(x: object, pattern: object, escape: str | None = None) -> str:
    return f"{x} NOT LIKE {pattern}{_escape(escape)}"


def in_(x: object, items: str | list[str]) -> str:
    return f"{x} IN ({items if isinstance(items, str) else ', '.join(items)})"


def not_in(x: object, items: str | list[str]) -> str:
    return f"{x} NOT IN ({items if isinstance(items, str) else ', '.join(items)})"


def regexp(x: object, pattern: object) -> str:
    return f"{x} RLIKE {pattern}"


def escape_like(text: str, escape: str) -> str:
    """Text whose wildcards and escape characters match themselves under that escape."""
    return "".join(escape + c if c in ("%", "_", escape) else c for c in text)


def length(x: str) -> str:
    """Characters, not bytes."""
    return f"char_length({x})"


def trim(x: str, mode: str = "BOTH", characters: str | None = None) -> str:
    if mode not in ("BOTH", "LEADING", "TRAILING"):
        raise NotSupported(f"no trim mode {mode}")
    return f"trim({mode} {characters if characters is not None else quote_string(' ')} FROM {x})"


def locate(x: str, part: str, start: str | int | None = None) -> str:
    """Where the part begins in x, counted from 1; 0 if it doesn't occur from start on."""
    return f"locate({part}, {x})" if start is None else f"locate({part}, {x}, {start})"


def substring(x: str, start: str | int, size: str | int | None = None) -> str:
    return f"substring({x}, {start})" if size is None else f"substring({x}, {start}, {size})"


def concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def mod(a: str, b: str) -> str:
    return f"mod({a}, {b})"


def bit_and(a: str, b: str) -> str:
    return f"({a} & {b})"


def bit_or(a: str, b: str) -> str:
    return f"({a} | {b})"


#: Units of date arithmetic.
UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def add_interval(moment: str, amount: str | int, unit: str) -> str:
    """amount is a number, a placeholder, an expression or a column."""
    if unit.upper() not in UNITS:
        raise NotSupported(f"no date unit {unit}")
    return f"timestampadd({unit.upper()}, {amount}, {moment})"


def sub_interval(moment: str, amount: str | int, unit: str) -> str:
    return add_interval(moment, f"-({amount})", unit)


def date_diff(later: str, earlier: str) -> str:
    """Calendar days between, whatever the times of day."""
    return f"datediff({later}, {earlier})"


def current_date() -> str:
    return "current_date()"


def current_time() -> str:
    """The time of day, of Spark's type TIME."""
    return "current_time()"


def current_timestamp() -> str:
    return "current_timestamp()"


def current_schema() -> str:
    return "current_schema()"


def dummy_select(expression: str = "1") -> str:
    """A statement of one row without a table."""
    return f"SELECT {expression}"


def literal(value: object) -> str:
    """A value as SQL text: null, boolean, number, bytes, date, time, timestamp or string."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, Decimal)):
        return f"{value}BD" if isinstance(value, Decimal) else str(value)
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex().upper()}'"
    if isinstance(value, datetime):
        return f"{'TIMESTAMP_NTZ' if value.tzinfo is None else 'TIMESTAMP'} '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, time):
        return f"TIME '{value.isoformat()}'"
    return quote_string(str(value))
