from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tidewater.functions import types
from tidewater.functions.errors import InvalidValue, MissingParameter, NotSupported, QueryError, TableNotFound
from tidewater.operators import portability, result, service, sqltext, tables
from tidewater.operators.engine import Engine
from tidewater.sources import catalog, rewrite
from tidewater.sources.model import Column, Table, changed_properties, schema_to_drop_sql


@pytest.fixture
def write_table(spark):
    spark.sql("DROP TABLE IF EXISTS write_table")
    spark.createDataFrame([(1, "foo"), (2, "bar"), (3, None)], "test_int int, test_string string").write.saveAsTable("write_table")
    yield "write_table"
    spark.sql("DROP TABLE IF EXISTS write_table")


def rows(spark, table):
    return sorted((tuple(r) for r in spark.table(table).collect()), key=str)


def test_insert_update_delete(spark, write_table):
    assert tables.insert(spark, write_table, {"test_int": 4}) == 1
    assert tables.update(spark, write_table, {"test_string": "new"}, {"test_string": None}) == 2
    assert tables.delete(spark, write_table, {"test_int": 1}) == 1
    assert rows(spark, write_table) == [(2, "bar"), (3, "new"), (4, "new")]
    with pytest.raises(QueryError):
        tables.delete(spark, write_table, {})
    with pytest.raises(QueryError):
        tables.insert(spark, write_table, {})
    assert tables.update(spark, write_table, {"test_int": 0}, {}, everything=True) == 3
    assert tables.delete(spark, write_table, {}, everything=True) == 3 and rows(spark, write_table) == []


@pytest.mark.parametrize("layout", ["", "PARTITIONED BY (p)", "CLUSTERED BY (x) INTO 2 BUCKETS"])
def test_changes_keep_the_layout(spark, layout):
    """Provider, partitioning, buckets, comments and properties survive; no row is lost."""
    spark.sql("DROP TABLE IF EXISTS kept")
    spark.sql(f"CREATE TABLE kept (x int COMMENT 'the x', s string, p string) USING orc {layout} COMMENT 'all of it' TBLPROPERTIES ('keeper' = 'me')")
    spark.sql("INSERT INTO kept VALUES (1, 'a', 'north'), (2, 'b', 'south'), (3, NULL, NULL), (4, 'd', 'north')")
    before, fields = rewrite.layout(spark, "kept"), spark.table("kept").schema
    assert tables.change(spark, "kept", {"s": "concat(s, '!')", "x": "x + 10"}, "p = 'north'") == 2
    assert tables.update(spark, "kept", {"s": "none"}, {"p": None}) == 1
    assert tables.delete(spark, "kept", {"p": "south"}) == 1 and tables.delete(spark, "kept", {"p": "west"}) == 0
    assert rows(spark, "kept") == [(11, "a!", "north"), (14, "d!", "north"), (3, "none", None)]
    assert tables.change(spark, "kept", {"p": "'east'"}, "x > 10") == 2 and tables.insert(spark, "kept", {"x": 5, "p": "north"}) == 1
    assert sorted(r.p or "" for r in spark.table("kept").collect()) == ["", "east", "east", "north"]
    after = rewrite.layout(spark, "kept")
    assert (after.provider, after.comment, after.partitions, after.bucketed, after.properties) == (before.provider, before.comment, before.partitions, before.bucketed, before.properties)
    assert spark.table("kept").schema == fields
    spark.sql("DROP TABLE kept")


def test_alter_keeps_the_layout_and_settles(spark):
    for name in ("changed", "changed__new", "changed__old"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql("CREATE TABLE changed (x int COMMENT 'the x', p string) USING orc PARTITIONED BY (p) COMMENT 'all' TBLPROPERTIES ('keeper' = 'me')")
    spark.sql("INSERT INTO changed VALUES (1, 'a'), (2, 'b')")
    new = StructType([StructField("x", LongType(), False, {"comment": "longer"}), StructField("p", StringType())])
    assert catalog.alter(spark, "changed", new) and not catalog.alter(spark, "changed", new)
    of = rewrite.layout(spark, "changed")
    assert (of.provider, of.comment, of.partitions, of.properties["keeper"]) == ("orc", "all", ("p",), "me") and rows(spark, "changed") == [(1, "a"), (2, "b")]
    assert [b.name for _, b in catalog.alter(spark, "changed", StructType([StructField("x", LongType(), True, {"comment": "other"}), StructField("p", StringType())])).changed] == ["x"]
    assert spark.table("changed").schema["x"].metadata["comment"] == "other"
    # Broken off between its two renames, the change is finished by the next one.
    spark.sql("CREATE TABLE changed__new USING parquet AS SELECT 7L AS x, 'c' AS p")
    spark.sql("ALTER TABLE changed RENAME TO changed__old")
    assert tables.update(spark, "changed", {"x": 8}, {"x": 7}) == 1 and rows(spark, "changed") == [(8, "c")] and not catalog.exists(spark, "changed__old")
    spark.sql("DROP TABLE changed")


def test_model_and_ddl(spark):
    table = Table("modelled", comment="m").add(Column("id", "bigint", nullable=False), Column("price", "decimal", precision=8, scale=3, comment="net"), Column("code", "string", length=4, fixed=True), Column("day", "date", default="current_date()"))
    assert table.to_sql() == "CREATE TABLE modelled (`id` bigint NOT NULL, `price` decimal(8,3) COMMENT 'net', `code` char(4), `day` date DEFAULT current_date()) USING parquet COMMENT 'm'"
    catalog.drop_tables(spark, "modelled", "renamed", missing_ok=True)
    catalog.create_tables(spark, table)
    found = catalog.introspect(spark, "modelled")
    assert (found.column("price").precision, found.column("price").scale, found.column("price").comment, found.column("code").length, found.column("code").fixed, found.column("day").default) == (8, 3, "net", 4, True, "current_date()")
    assert changed_properties(table.column("price"), found.column("price")) == [] and changed_properties(Column("a", "integer", precision=3), Column("a", "integer")) == []
    assert changed_properties(table.column("code"), table.modify("code", length=5, fixed=False).column("code")) == ["length", "fixed"]
    assert [c.name for c in table.drop("code").rename("day", "when").columns] == ["id", "price", "when"] and schema_to_drop_sql([table, Table("b")]) == ["DROP TABLE b", "DROP TABLE modelled"]
    for wrong in (lambda: table.column("no"), lambda: table.add(Column("ID")), lambda: Table("e").to_sql()):
        with pytest.raises(QueryError):
            wrong()
    catalog.comment_on_table(spark, "modelled", "it's new")
    catalog.rename_table(spark, "modelled", "renamed")
    assert rewrite.layout(spark, "renamed").comment == "it's new"
    Engine(spark).execute_statement("INSERT INTO renamed (id, code) VALUES (?, ?)", [1, "ab"])
    assert spark.table("renamed").first().day is not None
    catalog.truncate(spark, "renamed")
    assert spark.table("renamed").count() == 0
    diff = catalog.migrate(spark, [Table("renamed").add(Column("id", "bigint")), Table("fresh").add(Column("a"))])
    assert diff.created == ["fresh"] and spark.table("renamed").columns == ["id"] and catalog.exists(spark, "fresh")
    catalog.create_schema(spark, "other")
    assert "other" in catalog.list_schemas(spark)
    catalog.drop_schema(spark, "other")
    catalog.create_view(spark, "seen", "SELECT 1 AS a")
    assert "seen" in catalog.list_views(spark)
    catalog.drop_view(spark, "seen")
    catalog.create_temporary_table(spark, "short", spark.range(3))
    assert spark.table("short").count() == 3
    catalog.drop_tables(spark, "renamed", "fresh")


def test_engine(spark, write_table):
    engine = Engine(spark)
    assert engine.fetch_one("SELECT count(*) FROM write_table WHERE test_int IN (:some)", {"some": [1, 3]}) == 2
    statement = engine.prepare("SELECT test_string FROM write_table WHERE test_int = ?")
    assert [statement.bind_value(1, i).execute_query().first()[0] for i in (1, 2)] == ["foo", "bar"]
    assert engine.prepare("SELECT :a AS x").bind_value(":a", 4).execute_query().first()[0] == 4
    for wrong in (lambda: engine.prepare("?").bind_value(0, 1), lambda: engine.prepare("SELECT ?, ?").bind_value(2, 1).execute_query()):
        with pytest.raises(MissingParameter):
            wrong()
    q = engine.query_builder().select("test_int", "test_string").from_(write_table).where("test_int < 3").order_by("test_int")
    assert q.fetch_all_key_value() == {"1": "foo", "2": "bar"} and q.fetch_first_column() == [1, 2] and list(q.iterate_numeric()) == [(1, "foo"), (2, "bar")]
    assert engine.query_builder().insert_with(write_table, {"test_int": 9, "test_string": "it's"}).execute_statement() == 1
    assert engine.query_builder().update_with(write_table, {"test_string": "x"}).where("test_int = ?").set_parameters(["x", 9]).execute_statement() == 1
    assert engine.execute_statement(engine.query_builder().delete(write_table).where("test_string IS NULL")) == 1
    assert engine.insert(write_table, {"test_int": 5}) + engine.update(write_table, {"test_int": 6}, {"test_int": 5}) + engine.delete(write_table, {"test_int": 6}) == 3
    assert rows(spark, write_table) == [(1, "foo"), (2, "bar"), (9, "x")]


def test_what_spark_has_not_raises():
    for missing in (tables.transaction, tables.last_insert_id, catalog.create_sequence, catalog.create_index):
        with pytest.raises(NotSupported):
            missing()


def test_catalogue(spark, write_table):
    assert write_table in catalog.list_tables(spark) and catalog.exists(spark, "WRITE_TABLE") and "default" in catalog.list_schemas(spark)
    assert [(r.name, r.logical) for r in catalog.describe(spark, write_table).orderBy("position").collect()] == [("test_int", "integer"), ("test_string", "string")]
    with pytest.raises(TableNotFound):
        catalog.describe(spark, "nowhere")


def test_compare_and_alter(spark, write_table):
    new = StructType([StructField("test_int", LongType()), StructField("label", StringType()), StructField("extra", IntegerType())])
    diff = catalog.alter(spark, write_table, new)
    assert diff.renamed == [("test_string", "label")] and [f.name for f in diff.added] == ["extra"] and [b.name for _, b in diff.changed] == ["test_int"]
    assert rows(spark, write_table) == [(1, "foo", None), (2, "bar", None), (3, None, None)]
    assert not catalog.compare(spark.table(write_table).schema, new)
    two = catalog.compare(StructType([StructField("a", StringType())]), StructType([StructField("b", StringType()), StructField("c", StringType())]))
    assert not two.renamed and len(two.added) == 2
    assert catalog.compare_schemas({"x": new}, {"y": new}).created == ["y"]


def test_fetching(spark):
    df = spark.sql("SELECT * FROM VALUES ('foo', 1), ('bar', 2), ('foo', 3) AS t(a, b)").coalesce(1)
    assert result.fetch_associative(df) == {"a": "foo", "b": 1} and result.fetch_numeric(df) == ("foo", 1) and result.fetch_one(df) == "foo"
    assert result.fetch_all_numeric(df) == [("foo", 1), ("bar", 2), ("foo", 3)] and result.fetch_first_column(df) == ["foo", "bar", "foo"]
    assert result.fetch_all_key_value(df) == {"foo": 3, "bar": 2} and result.fetch_all_associative_indexed(df) == {"foo": {"b": 3}, "bar": {"b": 2}}
    assert list(result.iterate_numeric(df)) == result.fetch_all_numeric(df) and [r["b"] for r in result.iterate_associative(df)] == [1, 2, 3]
    assert list(result.iterate_column(df)) == ["foo", "bar", "foo"] and list(result.iterate_key_value(df))[-1] == ("foo", 3)
    assert list(result.iterate_associative_indexed(df))[0] == ("foo", {"b": 1})
    assert result.row_count(df) == 3 and result.column_count(df) == 2 and result.column_name(df, 1) == "b"
    for bad in (2, -1):
        with pytest.raises(QueryError):
            result.column_name(df, bad)
    with pytest.raises(QueryError):
        result.fetch_all_key_value(df.select("a"))
    none = df.where("false")
    assert result.fetch_one(none) is None and result.fetch_associative(none) is None and result.fetch_all_associative(none) == []
    assert result.fetch_associative(spark.sql("SELECT 1 a, 2 a")) == {"a": 2}


def test_portability(spark):
    df = spark.createDataFrame([(1, "foo \t"), (2, ""), (3, "   "), (4, None), (5, "x\u00a0\u3000\ufeff"), (6, "y\u0085"), (7, "z\n\n")], "Id int, Test string")
    found = {r.id: r.test for r in portability.normalise(df).collect()}
    assert found == {1: "foo", 2: None, 3: "", 4: None, 5: "x", 6: "y\u0085", 7: "z"}
    kept = portability.normalise(df, portability.Portability.EMPTY_TO_NULL)
    assert kept.columns == ["Id", "Test"] and kept.where("Id = 1").first().Test == "foo \t"
    assert portability.normalise(df, portability.Portability.FIX_CASE, upper=True).columns == ["ID", "TEST"]


def test_types(spark):
    assert types.bound(datetime(2020, 1, 2, 3, 4, 5), "datetime") == "2020-01-02 03:04:05" and types.bound(None, "date") is None
    assert types.bound([], "simple_array") is None and types.bound(["a", "b"], "simple_array") == "a,b" and types.bound(True, "boolean") == 1
    assert types.bound("1.5", "decimal") == Decimal("1.5") and types.bound({"a": 1}, "json") == '{"a": 1}'
    for value, name in (("x", "date"), ("short", "guid"), (1, "no_such_type")):
        with pytest.raises(InvalidValue):
            types.bound(value, name)
    assert types.logical_name("decimal(10,2)") == "decimal" and types.logical_name("timestamp_ntz") == "datetime"
    with pytest.raises(InvalidValue):
        types.logical_name("geography")
    df = spark.sql("SELECT * FROM VALUES ('a,b'), (''), (NULL) AS t(x)")
    assert [r[0] for r in df.select(types.get_type("simple_array").decode(F.col("x"))).collect()] == [["a", "b"], [], []]
    assert [r[0] for r in spark.sql("SELECT * FROM VALUES ('{\"a\":1}'), ('') AS t(x)").select(types.get_type("json").decode(F.col("x")).cast("string")).collect()] == ['{"a":1}', None]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        spark.sql("SELECT '{' AS x").select(types.get_type("json").decode(F.col("x")).cast("string")).collect()
    with pytest.raises(Exception, match="enumeration"):
        df.select(types.one_of(F.col("x"), ["a"])).collect()
    assert len(types.type_names()) == 29
    with pytest.raises(ValueError):
        types.add_type(types.get_type("text"))


def test_service(spark, write_table):
    found = service.execute(spark, "SELECT id FROM range(10) ORDER BY id", max_rows=3)
    assert found.pop("duration_ms") > 0
    assert found == {"columns": ["id"], "rows": [{"id": 0}, {"id": 1}, {"id": 2}], "row_count": 4, "returned_row_count": 3, "truncated": True}
    assert service.execute(spark, "SELECT test_int FROM write_table WHERE test_int IN (?)", [[1, 9]])["rows"] == [{"test_int": 1}]
    assert service.to_json({"a": 2**60, "b": b"x", "c": float("inf"), "d": Decimal("1.0"), "e": [datetime(2020, 1, 1)]}) == {"a": str(2**60), "b": {"$binary": True, "base64": "eA=="}, "c": "inf", "d": "1.0", "e": ["2020-01-01T00:00:00"]}
    assert service.redact("pg://me:secret@host/x?password=abc") == "pg://***@host/x?password=***"
    assert "write_table" in service.tables(spark) and service.describe(spark, write_table)[0]["name"] == "test_int" and service.info(spark)["engine"] == "spark"
    with pytest.raises(QueryError):
        service.execute(spark, "SELECT x FROM nowhere")
    assert service.schemas(spark) and service.info(spark)["schema"] == "default"
    hidden = service.redact("password: x1 pwd='x2' {\"token\": \"x3\"} Authorization: Bearer x4.y key=kept", ("kept",))
    assert not any(f"x{i}" in hidden for i in range(1, 5)) and "kept" not in hidden
    with pytest.raises(QueryError, match=r"^(?!.*s3cret)"):
        service.execute(spark, "SELECT raise_error('s3cret')", secrets=("s3cret",))


def test_sql_text(spark):
    text = "SELECT a, -- note\n  'it''s  -- no' AS b /* x\n y */ FROM  t\tWHERE n >= 10.5 AND d = '2020' # end"
    row = spark.createDataFrame([(text,), (None,), ("",)], "s string").select(sqltext.compress(F.col("s")), sqltext.tokens(F.col("s")), sqltext.shape(F.col("s"))).collect()
    assert row[0][0] == "SELECT a, 'it''s  -- no' AS b FROM t WHERE n >= 10.5 AND d = '2020'"
    assert row[0][1][:3] == ["SELECT", "a", ","] and ">=" in row[0][1] and not any("note" in t for t in row[0][1])
    assert row[0][2].startswith("SELECT A , ? ") and row[0][2].endswith("N >= ? AND D = ?")
    assert row[1][0] is None and row[2][0] == ""
