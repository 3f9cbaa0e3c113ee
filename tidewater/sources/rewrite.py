"""Writing catalogue tables anew without losing what the catalogue says of them.

A table of files can't change rows in place. The new rows are staged beside the table
first, so a job that fails leaves the table as it was:

- a table without partitions and buckets then gets the staged folder as its location, in
  one step of the catalogue, and the old folder is removed;
- of a partitioned table only the partitions that changed are overwritten;
- a new schema needs a new table: it is made with the old provider, partitioning, comment
  and properties and takes over the name. If that is broken off between the two renames
  the next change of the table finishes it.

Readers that began before see the old files until they are removed, and have to be
started again then.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.functions.errors import NotSupported
from tidewater.functions.exprs import quote_identifier, quote_string


@dataclass(frozen=True)
class Layout:
    """What the catalogue says of a table, besides its columns."""

    provider: str
    location: str
    comment: str | None = None
    partitions: tuple[str, ...] = ()
    bucketed: bool = False
    properties: dict[str, str] = field(default_factory=dict)


def layout(spark: SparkSession, table: str) -> Layout:
    facts: dict[str, str] = {}
    for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect():
        facts[row["col_name"]] = row["data_type"]
    columns = spark.catalog.listColumns(table)
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if not r["key"].startswith("transient")}
    partitions = tuple(c.name for c in columns if c.isPartition)
    return Layout(facts["Provider"], facts["Location"], facts.get("Comment") or None, partitions, any(c.isBucket for c in columns), properties)


def clauses(of: Layout) -> str:
    """The part of CREATE TABLE behind the columns."""
    text = f" USING {of.provider}"
    if of.partitions:
        text += f" PARTITIONED BY ({', '.join(map(quote_identifier, of.partitions))})"
    if of.comment:
        text += f" COMMENT {quote_string(of.comment)}"
    if of.properties:
        text += " TBLPROPERTIES (" + ", ".join(f"{quote_string(k)} = {quote_string(v)}" for k, v in of.properties.items()) + ")"
    return text


def column_clauses(schema: StructType) -> str:
    parts = []
    for f in schema:
        comment = f.metadata.get("comment")
        parts.append(f"{quote_identifier(f.name)} {f.dataType.simpleString()}" + (f" COMMENT {quote_string(comment)}" if comment else ""))
    return ", ".join(parts)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def recover(spark: SparkSession, table: str) -> None:
    """Finish a change of schema that was broken off between its renames."""
    if not spark.catalog.tableExists(table):
        for left in (f"{table}__new", f"{table}__old"):
            if spark.catalog.tableExists(left):
                spark.sql(f"ALTER TABLE {left} RENAME TO {table}")
                break
    if spark.catalog.tableExists(table):
        for left in (f"{table}__new", f"{table}__old"):
            spark.sql(f"DROP TABLE IF EXISTS {left}")


def replace_rows(spark: SparkSession, table: str, rows: DataFrame, touched: DataFrame | None = None) -> None:
    """Give a table other rows of the same schema.

    touched holds the partition columns' values of all partitions that changed; rows has
    then to be their rows only.
    """
    of = layout(spark, table)
    stage = f"{of.location.rstrip('/')}__{uuid.uuid4().hex}"
    if not of.partitions and not of.bucketed:
        rows.write.format(of.provider).save(stage)
        spark.sql(f"ALTER TABLE {table} SET LOCATION {quote_string(stage)}")
        spark.catalog.refreshTable(table)
        _remove(spark, of.location)
        return
    rows.write.parquet(stage)
    staged = spark.read.schema(rows.schema).parquet(stage)
    if touched is not None and of.partitions:
        # A partition that has lost all its rows isn't overwritten: it is dropped.
        keys = touched.select(*of.partitions).distinct()
        gone = keys.join(staged.select(*of.partitions).distinct(), [keys[p].eqNullSafe(staged[p]) for p in of.partitions], "left_anti").collect()
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")  # inserts don't heed the writer's own option
        try:
            staged.write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(mode, before)
        for row in gone:
            spec = ", ".join(f"{quote_identifier(p)} = {'NULL' if row[p] is None else quote_string(str(row[p]))}" for p in of.partitions)
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
    else:
        staged.write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)
    _remove(spark, stage)


def replace_schema(spark: SparkSession, table: str, rows: DataFrame, schema: StructType) -> None:
    """Give a table another schema, with rows of that schema."""
    of = layout(spark, table)
    if of.bucketed:
        raise NotSupported(f"{table} is bucketed: make a new table and insert its rows")
    names = {n.lower() for n in schema.names}
    of = Layout(of.provider, of.location, of.comment, tuple(p for p in of.partitions if p.lower() in names), False, of.properties)
    fresh, old = f"{table}__new", f"{table}__old"
    spark.sql(f"CREATE TABLE {fresh} ({column_clauses(schema)}){clauses(of)}")
    try:
        rows.select(*[F.col(quote_identifier(c)) for c in spark.table(fresh).columns]).write.insertInto(fresh)
    except Exception:
        spark.sql(f"DROP TABLE {fresh}")
        raise
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")
    spark.catalog.refreshTable(table)
