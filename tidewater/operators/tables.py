"""Insert, update and delete on catalogue tables without transactions.

Tables of files can't change rows in place: an update or delete writes them anew (see
sources.rewrite), partitioned ones only where rows changed, and nothing where none do.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.errors import NotSupported, QueryError, converted
from tidewater.functions.exprs import literal, quote_identifier
from tidewater.sources import rewrite


def _criteria(criteria: dict[str, Any]) -> str:
    """All columns equal; None means null."""
    parts = [f"{quote_identifier(c)} IS NULL" if v is None else f"{quote_identifier(c)} = {literal(v)}" for c, v in criteria.items()]
    return " AND ".join(parts) or "true"


def _known(names: list[str], columns: list[str], table: str) -> None:
    there = {c.lower() for c in columns}
    if unknown := [n for n in names if n.strip("`").lower() not in there]:
        raise QueryError(f"{table} has no columns {', '.join(sorted(unknown))}")


def insert(spark: SparkSession, table: str, values: dict[str, Any]) -> int:
    """Add one row; columns that aren't named are null."""
    if not values:
        raise QueryError("an insert needs values")
    with converted():
        schema = spark.table(table).schema
        _known(list(values), schema.names, table)
        row = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
        spark.range(1).select(*row).write.insertInto(table)
    return 1


def insert_rows(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Add all rows of a DataFrame by column name."""
    with converted():
        rows.select(*spark.table(table).columns).write.insertInto(table)


def insert_query(spark: SparkSession, table: str, columns: list[str], rows: DataFrame) -> int:
    """Add the rows of a query to the named columns in order; the others are null.

    Returns how many there are.
    """
    schema = spark.table(table).schema
    _known(columns, schema.names, table)
    if len(columns) != len(rows.columns):
        raise QueryError(f"{len(columns)} columns are named, the query has {len(rows.columns)}")
    named = rows.toDF(*[f"c{i}" for i in range(len(columns))])
    place = {c.strip("`").lower(): f"c{i}" for i, c in enumerate(columns)}
    made = [(F.col(place[f.name.lower()]) if f.name.lower() in place else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    out = named.select(*made)
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(table)
    return seen.get["n"]


def change(spark: SparkSession, table: str, values: dict[str, str] | None, where: str, args: dict[str, Any] | None = None) -> int:
    """Set columns of the rows for which the predicate holds, or without values delete them.

    values and where are Spark SQL expressions over the row; args are their named
    parameters. All values are taken from the row as it was. Returns how many rows hold.
    """
    with converted():
        rewrite.recover(spark, table)
        schema = spark.table(table).schema
        if values is not None:
            if not values:
                raise QueryError("an update needs values")
            _known(list(values), schema.names, table)
        select = lambda what, rest="": spark.sql(f"SELECT {what} FROM {table}{rest}", args=args or {})
        holds = f"coalesce(({where}), false)"
        count = select("count(*)", f" WHERE {holds}").first()[0]
        if not count:
            return 0
        partitions = rewrite.layout(spark, table).partitions
        given = {} if values is None else {c.strip("`").lower(): v for c, v in values.items()}
        moves = {p.lower() for p in partitions} & set(given)
        made = [f"CAST(CASE WHEN {holds} THEN {given[f.name.lower()]} ELSE {quote_identifier(f.name)} END AS {f.dataType.simpleString()}) AS {quote_identifier(f.name)}" if f.name.lower() in given else quote_identifier(f.name) for f in schema]
        rest = f" WHERE NOT {holds}" if values is None else ""
        # Where rows move between partitions all of the table is written.
        touched = select(", ".join(map(quote_identifier, partitions)), f" WHERE {holds}").distinct() if partitions and not moves else None
        rows = select(", ".join(made), rest)
        if touched is not None:
            rows = rows.join(F.broadcast(touched.withColumnsRenamed({p: f"__{p}" for p in partitions})), [F.col(quote_identifier(p)).eqNullSafe(F.col(f"__{p}")) for p in partitions], "left_semi")
            touched = spark.createDataFrame(touched.collect(), touched.schema)
        rewrite.replace_rows(spark, table, rows, touched)
    return count


def update(spark: SparkSession, table: str, values: dict[str, Any], criteria: dict[str, Any], everything: bool = False) -> int:
    """Set columns of the rows that match; without criteria only if everything is asked for."""
    if not criteria and not everything:
        raise QueryError("an update without criteria changes every row; ask for it with everything=True")
    return change(spark, table, {c: literal(v) for c, v in values.items()}, _criteria(criteria))


def delete(spark: SparkSession, table: str, criteria: dict[str, Any], everything: bool = False) -> int:
    """Remove the rows that match; without criteria only if everything is asked for."""
    if not criteria and not everything:
        raise QueryError("a delete without criteria removes every row; ask for it with everything=True")
    return change(spark, table, None, _criteria(criteria))


def transaction() -> None:
    raise NotSupported("Parquet tables have no transactions, savepoints or isolation levels")


def last_insert_id() -> None:
    raise NotSupported("Parquet tables have no identity columns")
