"""Tables as plain values: columns with their properties, and their DDL."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql.types import StructType

from tidewater.functions.errors import QueryError
from tidewater.functions.exprs import quote_identifier, quote_string
from tidewater.functions.types import spark_type


@dataclass(frozen=True)
class Column:
    """A column of a logical type; default is a Spark SQL expression such as current_date()."""

    name: str
    type: str = "string"
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    fixed: bool = False
    nullable: bool = True
    default: str | None = None
    comment: str | None = None
    values: tuple[str, ...] = ()

    @property
    def spark(self) -> str:
        return spark_type(self.type, self.length, self.precision, self.scale, self.fixed)

    def to_sql(self) -> str:
        text = f"{quote_identifier(self.name)} {self.spark}"
        text += "" if self.nullable else " NOT NULL"
        text += f" DEFAULT {self.default}" if self.default is not None else ""
        return text + (f" COMMENT {quote_string(self.comment)}" if self.comment else "")


#: Integers have no precision or scale to compare.
_WHOLE = ("smallint", "integer", "bigint")


def changed_properties(old: Column, new: Column) -> list[str]:
    """Names of the properties that differ; precision and scale don't count for integers."""
    names = ["type", "length", "precision", "scale", "fixed", "nullable", "default", "comment", "values"]
    if old.type in _WHOLE and new.type in _WHOLE:
        names = [n for n in names if n not in ("precision", "scale")]
    return [n for n in names if getattr(old, n) != getattr(new, n)]


@dataclass(frozen=True)
class Table:
    """A table to be made; the methods give a changed copy."""

    name: str
    columns: tuple[Column, ...] = ()
    provider: str = "parquet"
    partitions: tuple[str, ...] = ()
    comment: str | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise QueryError(f"table {self.name} has no column {name}")

    def add(self, *columns: Column) -> Table:
        names = [c.name.lower() for c in (*self.columns, *columns)]
        for name in names:
            if names.count(name) > 1:
                raise QueryError(f"table {self.name} has column {name} twice")
        return replace(self, columns=(*self.columns, *columns))

    def drop(self, name: str) -> Table:
        gone = self.column(name)
        return replace(self, columns=tuple(c for c in self.columns if c is not gone))

    def modify(self, name: str, /, **changes: object) -> Table:
        old = self.column(name)
        return replace(self, columns=tuple(replace(c, **changes) if c is old else c for c in self.columns))

    def rename(self, name: str, new: str) -> Table:
        return self.modify(name, name=new)

    def to_sql(self) -> str:
        if not self.columns:
            raise QueryError(f"table {self.name} has no columns")
        text = f"CREATE TABLE {self.name} ({', '.join(c.to_sql() for c in self.columns)}) USING {self.provider}"
        text += f" PARTITIONED BY ({', '.join(map(quote_identifier, self.partitions))})" if self.partitions else ""
        text += f" COMMENT {quote_string(self.comment)}" if self.comment else ""
        if self.properties:
            text += " TBLPROPERTIES (" + ", ".join(f"{quote_string(k)} = {quote_string(v)}" for k, v in self.properties.items()) + ")"
        return text

    def drop_sql(self) -> str:
        return f"DROP TABLE {self.name}"

    def schema(self) -> StructType:
        return StructType.fromDDL(", ".join(replace(c, default=None, nullable=True).to_sql() for c in self.columns))


def schema_to_sql(tables: list[Table]) -> list[str]:
    return [t.to_sql() for t in tables]


def schema_to_drop_sql(tables: list[Table]) -> list[str]:
    return [t.drop_sql() for t in reversed(tables)]
