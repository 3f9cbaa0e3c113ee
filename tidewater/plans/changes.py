"""Registered queries that change tables, run statements and fetch results.

Each change works on a table of its own, made from a whole input table.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewater.functions import exprs as e
from tidewater.functions.types import get_type, one_of
from tidewater.operators import service, tables
from tidewater.operators.builder import QueryBuilder
from tidewater.operators.engine import Engine
from tidewater.plans.registry import register
from tidewater.sources import catalog
from tidewater.sources.model import Column, Table


def _copy(spark: SparkSession, sf_dir: str, source: str, partition: str | None = None) -> str:
    """A table of this query's own with the rows of an input table."""
    name = f"tidewater_{source}_{uuid.uuid4().hex[:12]}"
    rows = catalog.read(spark, "parquet", f"{sf_dir}/{source}.parquet")
    writer = rows.write.format("parquet")
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    return name


_PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


@register("update_rows", f"SELECT {_PART.replace('p_size', 'CASE WHEN p_brand = $$Brand#11$$ THEN 99 ELSE p_size END AS p_size')} FROM part".replace("$$", "'"))
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _copy(spark, sf_dir, "part")
    tables.update(spark, name, {"p_size": 99}, {"p_brand": "Brand#11"})
    return spark.table(name)


@register("delete_rows", f"SELECT {_PART} FROM part WHERE p_brand <> 'Brand#23'")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _copy(spark, sf_dir, "part")
    tables.delete(spark, name, {"p_brand": "Brand#23"})
    return spark.table(name)


@register("insert_row", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, NULL")
def insert_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _copy(spark, sf_dir, "region")
    tables.insert(spark, name, {"r_regionkey": 77})
    return spark.table(name)


@register("builder_update_partitioned", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def builder_update_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the partitions that hold a changed row are written."""
    q = QueryBuilder().update(_copy(spark, sf_dir, "customer", "c_mktsegment"))
    q.set("c_acctbal", f"c_acctbal + {q.create_named_parameter(1000)}").where(e.lt("c_acctbal", "0")).and_where(e.eq("c_mktsegment", q.create_named_parameter("BUILDING")))
    q.apply(spark)
    return spark.table(q.change[1])


@register("builder_delete", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT (c_mktsegment = 'MACHINERY' OR c_acctbal < 0)")
def builder_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition is emptied, the others lose rows."""
    q = QueryBuilder().delete(_copy(spark, sf_dir, "customer", "c_mktsegment")).where(e.or_(e.eq("c_mktsegment", "?"), e.lt("c_acctbal", "?")))
    q.set_parameters(["MACHINERY", 0]).apply(spark)
    return spark.table(q.change[1])


@register(
    "builder_insert_from",
    "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 1000, NULL, r_regionkey FROM region WHERE r_regionkey > 1 UNION ALL SELECT 5, 'five', 9",
)
def builder_insert_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _copy(spark, sf_dir, "nation")
    catalog.register(spark, sf_dir, ("region",))
    q = QueryBuilder()
    part = q.sub().select("r_regionkey + 1000", "r_regionkey").from_("region").where(e.gt("r_regionkey", q.create_named_parameter(1)))
    q.insert_from(name, ("n_nationkey", "n_regionkey"), part).apply(spark)
    QueryBuilder().insert_with(name, {"n_nationkey": 5, "n_name": "five", "n_regionkey": 9}, named=True).apply(spark)
    return spark.table(name)


@register("alter_table", "SELECT s_suppkey AS supplier, s_name, CAST(s_acctbal AS DECIMAL(14,2)) AS s_acctbal, NULL::VARCHAR AS note FROM supplier")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column renamed, one dropped, one of another type, one new."""
    name = _copy(spark, sf_dir, "supplier")
    old = spark.table(name).schema
    named = StructType([StructField("supplier", old["s_suppkey"].dataType)])
    catalog.alter(spark, name, StructType.fromDDL(f"supplier {named[0].dataType.simpleString()}, s_name string, s_nationkey int, s_acctbal decimal(14,2)"))
    catalog.alter(spark, name, StructType.fromDDL(f"supplier {named[0].dataType.simpleString()}, s_name string, s_acctbal decimal(14,2), note string"))
    return spark.table(name)


@register("created_table", "SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS DECIMAL(6,1)) AS region, 'none' AS remark FROM nation")
def created_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made from a model, with a default; other columns from a query."""
    catalog.register(spark, sf_dir, ("nation",))
    made = Table(f"tidewater_made_{uuid.uuid4().hex[:12]}").add(Column("id", "integer", nullable=False), Column("name", "string", length=40), Column("region", "decimal", precision=6, scale=1), Column("remark", default="'none'"))
    catalog.create_tables(spark, made)
    Engine(spark).execute_statement(f"INSERT INTO {made.name} (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return spark.table(made.name)


@register("in_list_name_clash", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND p_brand = 'Brand#11' OR p_size = 7")
def in_list_name_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that are named as a list's own placeholders would be."""
    catalog.register(spark, sf_dir, ("part",))
    sql = "SELECT p_partkey FROM part WHERE p_size IN (:a) AND p_brand = :a_1 OR p_size = :a_2"
    return Engine(spark).execute_query(sql, {"a": [1, 2, 3], "a_1": "Brand#11", "a_2": 7})


@register("prepared_statement", "SELECT o_orderkey, 'it''s' AS note FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions count from 1 and may be bound in any order."""
    catalog.register(spark, sf_dir, ("orders",))
    statement = Engine(spark).prepare("SELECT o_orderkey, ? AS note FROM orders WHERE o_orderstatus = ? AND o_totalprice BETWEEN ? AND ?")
    return statement.bind_value(4, 50000).bind_value(1, "it's").bind_value(3, 1000).bind_value(2, "F").execute_query()


@register("positional_placeholders", "SELECT p_partkey, p_size + 3 AS more FROM part WHERE p_size > 5 AND p_size < 40 AND p_brand IN ('Brand#11', 'Brand#12') AND p_name <> '?'")
def positional_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.register(spark, sf_dir, ("part",))
    q = Engine(spark).query_builder()
    q.select("p_partkey", f"p_size + {q.create_positional_parameter(3)} AS more").from_("part")
    q.where(e.gt("p_size", q.create_positional_parameter(5)), e.lt("p_size", q.create_positional_parameter(40)), e.in_("p_brand", q.create_positional_parameter(["Brand#11", "Brand#12"])), "p_name <> '?'")
    return q.execute_query()


@register(
    "literals",
    r"""SELECT n_nationkey, 'it''s \ "x"' AS s, CAST(1.50 AS DECIMAL(3,2)) AS d, 2.5::DOUBLE AS f, TRUE AS b, NULL::INTEGER AS n, DATE '2021-03-04' AS day, TIMESTAMP '2021-03-04 05:06:07' AS at, n_name AS "odd `name" FROM nation""",
)
def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.register(spark, sf_dir, ("nation",))
    values = {"s": 'it\'s \\ "x"', "d": Decimal("1.50"), "f": 2.5, "b": True, "day": date(2021, 3, 4), "at": datetime(2021, 3, 4, 5, 6, 7)}
    q = QueryBuilder().select("n_nationkey", *[f"{e.literal(v)} AS {k}" for k, v in values.items()], f"CAST({e.literal(None)} AS int) AS n", f"n_name AS {e.quote_identifier('odd `name')}")
    return q.from_("nation").to_df(spark)


@register("fetch_helpers", "SELECT 'pair' AS kind, r_regionkey::VARCHAR AS k, r_name AS v FROM region UNION ALL SELECT 'indexed', r_regionkey::VARCHAR, r_name FROM region UNION ALL SELECT 'first', NULL, (SELECT min(r_name) FROM region)")
def fetch_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region table, of fixed size, through the functions that bring rows to the driver."""
    catalog.register(spark, sf_dir, ("region",))
    engine = Engine(spark)
    q = "SELECT r_regionkey, r_name FROM region ORDER BY r_name"
    rows = [("pair", k, v) for k, v in engine.fetch_all_key_value(q).items()]
    rows += [("indexed", k, v["r_name"]) for k, v in engine.fetch_all_associative_indexed(q).items()]
    rows.append(("first", None, engine.fetch_one("SELECT r_name FROM region ORDER BY r_name")))
    return spark.createDataFrame(rows, "kind string, k string, v string")


@register("service_rows", "SELECT n_nationkey AS id, n_name AS name, 25::BIGINT AS returned, FALSE AS truncated FROM nation")
def service_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole small table as the service replies with it."""
    catalog.register(spark, sf_dir, ("nation",))
    reply = service.execute(spark, "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey >= ?", [0])
    rows = [(r["id"], r["name"], reply["returned_row_count"], reply["truncated"]) for r in reply["rows"]]
    return spark.createDataFrame(rows, "id int, name string, returned long, truncated boolean")


@register("current_values", "SELECT n_nationkey, TRUE AS same_day, TRUE AS in_day, 'default' AS schema FROM nation")
def current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Now in its parts: they can only be compared with each other."""
    catalog.register(spark, sf_dir, ("nation",))
    q = QueryBuilder().select("n_nationkey", f"{e.current_date()} = to_date({e.current_timestamp()}) AS same_day", f"{e.current_time()} BETWEEN TIME '00:00:00' AND TIME '23:59:59.999999' AS in_day", f"{e.current_schema()} AS schema")
    return q.from_("nation").to_df(spark)


@register("dummy_select", "SELECT 1 + 1 AS two")
def dummy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).execute_query(e.dummy_select("1 + 1 AS two"))


@register(
    "table_description",
    "SELECT * FROM (VALUES (0, 'p_partkey', 'bigint'), (1, 'p_name', 'string'), (2, 'p_brand', 'string'), (3, 'p_type', 'string'), (4, 'p_size', 'integer'), (5, 'p_retailprice', 'float')) AS t(position, name, logical)",
)
def table_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.describe(spark, _copy(spark, sf_dir, "part")).select("position", "name", "logical")


@register("row_iteration", "SELECT r_regionkey AS k, r_name AS v FROM region")
def row_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region table, of fixed size, one row at a time."""
    catalog.register(spark, sf_dir, ("region",))
    q = Engine(spark).query_builder().select("r_regionkey AS k", "r_name AS v").from_("region")
    return spark.createDataFrame([(r["k"], r["v"]) for r in q.iterate_associative()], "k int, v string")


@register("binary_and_length", "SELECT p_partkey, encode(p_name) AS bytes, octet_length(encode(p_name)) AS n FROM part")
def binary_and_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.read(spark, "parquet", f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", get_type("blob").decode(F.col("p_name")).alias("bytes"), F.octet_length("p_name").alias("n"))


@register(
    "more_type_codecs",
    """SELECT event_id, user_id::INTEGER AS i, value AS f, value::FLOAT AS sf, (value * 100)::BIGINT AS b, CAST(ts AS VARCHAR)[:10]::DATE AS d, event_type AS kind, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S')::TIMESTAMP AS at FROM events""",
)
def more_type_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.read(spark, "parquet", f"{sf_dir}/events.parquet")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kinds = ["click", "view", "purchase", "scroll", "error", "signup", "login", "logout", "search", "add_to_cart"]
    read = lambda name, column: get_type(name).decode(column)
    return rows.select(
        "event_id",
        read("integer", F.col("user_id").cast("string")).alias("i"),
        read("float", F.col("value").cast("string")).alias("f"),
        read("smallfloat", F.col("value").cast("string")).alias("sf"),
        read("bigint", F.round(F.col("value") * 100).cast("long").cast("string")).alias("b"),
        read("date_immutable", F.substring(stamp, 1, 10)).alias("d"),
        one_of(F.col("event_type"), kinds).alias("kind"),
        read("time", F.substring(stamp, 12, 8)).alias("t"),
        read("datetimetz", F.concat(stamp, F.lit("+0000"))).cast("timestamp_ntz").alias("at"),
    )
