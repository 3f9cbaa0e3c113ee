"""The catalogue: views over files, listing, description, comparison and alteration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from tidewater.functions.errors import NotSupported, TableNotFound, converted
from tidewater.functions.exprs import quote_identifier, quote_string
from tidewater.functions.types import logical_name
from tidewater.sources import rewrite
from tidewater.sources.model import Column, Table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the folder's Parquet tables."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """Any source that Spark knows: parquet, orc, csv, json, text, jdbc and so on."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path or None)


def list_schemas(spark: SparkSession) -> list[str]:
    return [r[0] for r in spark.sql("SHOW SCHEMAS").collect()]


def list_tables(spark: SparkSession, keep: Callable[[str], bool] = lambda name: True) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.tableType != "VIEW" and keep(t.name))


def list_views(spark: SparkSession, keep: Callable[[str], bool] = lambda name: True) -> list[str]:
    return sorted(r["viewName"] for r in spark.sql("SHOW VIEWS").collect() if keep(r["viewName"]))


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def describe(spark: SparkSession, table: str) -> DataFrame:
    """One row per column: position, name, logical and Spark type, nullable, comment."""
    if not exists(spark, table):
        raise TableNotFound(f"there is no table {table}")
    rows = [(i, f.name, logical_name(f.dataType.simpleString()), f.dataType.simpleString(), f.nullable, f.metadata.get("comment")) for i, f in enumerate(spark.table(table).schema)]
    return spark.createDataFrame(rows, "position int, name string, logical string, spark string, nullable boolean, comment string")


@dataclass(frozen=True)
class TableDiff:
    """What turns one schema into the other; a rename only where it is the one candidate."""

    added: list[StructField] = field(default_factory=list)
    dropped: list[StructField] = field(default_factory=list)
    changed: list[tuple[StructField, StructField]] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.added or self.dropped or self.changed or self.renamed)


def _same(a: StructField, b: StructField) -> bool:
    """Nullability doesn't count: tables of files read every column as nullable."""
    return (a.dataType, a.metadata.get("comment")) == (b.dataType, b.metadata.get("comment"))


def compare(old: StructType, new: StructType) -> TableDiff:
    """Columns are matched by name without regard to case."""
    before, after = ({f.name.lower(): f for f in s} for s in (old, new))
    added = [f for n, f in after.items() if n not in before]
    dropped = [f for n, f in before.items() if n not in after]
    renamed = []
    for gone in list(dropped):
        match = [f for f in added if _same(f, gone)]
        if len(match) == 1 and sum(_same(match[0], d) for d in dropped) == 1:
            renamed.append((gone.name, match[0].name))
            dropped.remove(gone)
            added.remove(match[0])
    changed = [(before[n], f) for n, f in after.items() if n in before and not _same(before[n], f)]
    return TableDiff(added, dropped, changed, renamed)


@dataclass(frozen=True)
class SchemaDiff:
    created: list[str]
    dropped: list[str]
    altered: dict[str, TableDiff]


def compare_schemas(old: dict[str, StructType], new: dict[str, StructType]) -> SchemaDiff:
    altered = {t: d for t in new if t in old and (d := compare(old[t], new[t]))}
    return SchemaDiff(sorted(set(new) - set(old)), sorted(set(old) - set(new)), altered)


def alter(spark: SparkSession, table: str, new: StructType) -> TableDiff:
    """Bring a table to a new schema.

    Added columns are null in old rows; they and changed comments need only the
    catalogue. Renames, drops and changed types write the table anew under the new names
    and types, with its provider, partitioning, comment and properties.
    """
    with converted():
        rewrite.recover(spark, table)
        diff = compare(spark.table(table).schema, new)
        typed = [c for c in diff.changed if c[0].dataType != c[1].dataType]
        if diff.dropped or typed or diff.renamed:
            names = {b.lower(): a for a, b in diff.renamed}
            rows = spark.table(table)
            known = {c.lower() for c in rows.columns}
            made = []
            for f in new:
                source = names.get(f.name.lower(), f.name)
                value = quote_identifier(source) if source.lower() in known else "NULL"
                made.append(f"CAST({value} AS {f.dataType.simpleString()}) AS {quote_identifier(f.name)}")
            rewrite.replace_schema(spark, table, rows.selectExpr(*made), new)
        else:
            for _, f in diff.changed:
                comment_on_column(spark, table, f.name, f.metadata.get("comment"))
            if diff.added:
                spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({rewrite.column_clauses(StructType(diff.added))})")
    return diff


def _run(spark: SparkSession, *statements: str) -> None:
    with converted():
        for statement in statements:
            spark.sql(statement)


def create_tables(spark: SparkSession, *tables: Table) -> None:
    _run(spark, *[t.to_sql() for t in tables])


def drop_tables(spark: SparkSession, *names: str, missing_ok: bool = False) -> None:
    """In the opposite order of the names."""
    _run(spark, *[f"DROP TABLE {'IF EXISTS ' if missing_ok else ''}{n}" for n in reversed(names)])


def rename_table(spark: SparkSession, table: str, new: str) -> None:
    _run(spark, f"ALTER TABLE {table} RENAME TO {new}")


def truncate(spark: SparkSession, table: str) -> None:
    _run(spark, f"TRUNCATE TABLE {table}")


def create_schema(spark: SparkSession, name: str) -> None:
    _run(spark, f"CREATE SCHEMA {name}")


def drop_schema(spark: SparkSession, name: str, cascade: bool = False) -> None:
    _run(spark, f"DROP SCHEMA {name}{' CASCADE' if cascade else ''}")


def create_view(spark: SparkSession, name: str, query: object, replace: bool = False) -> None:
    _run(spark, f"CREATE {'OR REPLACE ' if replace else ''}VIEW {name} AS {query}")


def drop_view(spark: SparkSession, name: str) -> None:
    _run(spark, f"DROP VIEW {name}")


def create_temporary_table(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """A view of this session over the rows, which stay lazy."""
    rows.createOrReplaceTempView(name)


def comment_on_table(spark: SparkSession, table: str, comment: str | None) -> None:
    _run(spark, f"COMMENT ON TABLE {table} IS {'NULL' if comment is None else quote_string(comment)}")


def comment_on_column(spark: SparkSession, table: str, column: str, comment: str | None) -> None:
    _run(spark, f"ALTER TABLE {table} ALTER COLUMN {quote_identifier(column)} COMMENT {quote_string(comment or '')}")


def introspect(spark: SparkSession, table: str) -> Table:
    """The table as a model; types come back as logical ones with their sizes."""
    if not exists(spark, table):
        raise TableNotFound(f"there is no table {table}")
    of = rewrite.layout(spark, table)
    columns = []
    for f in spark.table(table).schema:
        # Sizes of varchar and char stand in the field's metadata.
        text = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
        head, _, sizes = text.rstrip(")").partition("(")
        sizes = [int(n) for n in sizes.split(",")] if sizes and head in ("decimal", "varchar", "char") else []
        decimal = head == "decimal"
        columns.append(
            Column(
                f.name,
                logical_name(text),
                length=sizes[0] if sizes and not decimal else None,
                precision=sizes[0] if decimal else None,
                scale=sizes[1] if decimal else None,
                fixed=head == "char",
                default=f.metadata.get("CURRENT_DEFAULT"),
                comment=f.metadata.get("comment") or None,
            )
        )
    return Table(table, tuple(columns), of.provider, of.partitions, of.comment, of.properties)


def migrate(spark: SparkSession, wanted: list[Table], drop: bool = False) -> SchemaDiff:
    """Make, alter and, if asked for, drop tables until the schema is as wanted."""
    there = {t: spark.table(t).schema for t in list_tables(spark)}
    diff = compare_schemas(there, {t.name: t.schema() for t in wanted})
    for table in wanted:
        if table.name in diff.created:
            create_tables(spark, table)
        elif table.name in diff.altered:
            alter(spark, table.name, table.schema())
    if drop:
        drop_tables(spark, *diff.dropped)
    return diff


def create_sequence(*_: object) -> None:
    raise NotSupported("Spark has no sequences")


def create_index(*_: object) -> None:
    raise NotSupported("Parquet tables have no indexes or enforced constraints")
