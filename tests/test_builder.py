from __future__ import annotations

import pytest

from tidewater.functions import exprs as e
from tidewater.functions.errors import InvalidFieldName, MissingParameter, NotSupported, QueryError, SyntaxErrorInQuery, TableNotFound
from tidewater.functions.params import compile_sql
from tidewater.operators.builder import QueryBuilder


def sql(q: QueryBuilder) -> str:
    return q.to_sql()


def test_clauses_come_in_order():
    q = QueryBuilder().select("u.id").distinct().from_("users", "u").where("u.a = 1").group_by("u.id").having("count(*) > 1").order_by("u.id", "DESC").set_max_results(5).set_first_result(2)
    assert sql(q) == "SELECT DISTINCT u.id FROM users u WHERE u.a = 1 GROUP BY u.id HAVING count(*) > 1 ORDER BY u.id DESC LIMIT 5 OFFSET 2"


def test_alias_equal_to_the_table_is_dropped():
    assert sql(QueryBuilder().select("id").from_("users", "users")) == "SELECT id FROM users"


def test_predicates_nest():
    q = QueryBuilder().select("1").from_("t").where("a").and_where("b").or_where("c").and_where("d")
    assert sql(q).endswith("WHERE (((a) AND (b)) OR (c)) AND (d)")


def test_one_part_stands_bare_and_composites_grow():
    assert str(e.and_("a")) == "a"
    assert str(e.or_("a", "b").with_("c")) == "(a) OR (b) OR (c)"
    assert len(e.or_("a", "b")) == 2


def test_joins_of_one_alias_first_then_deeper():
    q = QueryBuilder().select("1").from_("a", "a1").join("a1", "b", "b1", "x").join("b1", "c", "c1", "y").left_join("a1", "d", "d1", "z")
    assert sql(q) == "SELECT 1 FROM a a1 INNER JOIN b b1 ON x LEFT JOIN d d1 ON z INNER JOIN c c1 ON y"


@pytest.mark.parametrize(
    "make",
    [
        lambda: QueryBuilder().from_("t").to_sql(),
        lambda: QueryBuilder().select("1").from_("t", "a").join("a", "u", "a", "x").to_sql(),
        lambda: QueryBuilder().select("1").from_("t", "a").join("b", "u", "c", "x").to_sql(),
        lambda: QueryBuilder().union("SELECT 1").to_sql(),
        lambda: QueryBuilder().add_union("SELECT 1"),
        lambda: QueryBuilder().with_("c", "SELECT 1", ()),
        lambda: QueryBuilder().set_first_result(-1),
        lambda: QueryBuilder().for_update(),
    ],
)
def test_wrong_use_raises(make):
    with pytest.raises(QueryError):
        make()


def test_resets_clear_one_clause():
    q = QueryBuilder().select("a").from_("t").where("x").group_by("a").having("y").order_by("a")
    assert sql(q.reset_where().reset_group_by().reset_having().reset_order_by()) == "SELECT a FROM t"


def test_union_drops_earlier_parts():
    q = QueryBuilder().union("SELECT 9").union("SELECT 1").add_union("SELECT 2", every=True)
    assert sql(q) == "(SELECT 1) UNION ALL (SELECT 2)"


def test_parameters_switch_their_kind():
    q = QueryBuilder().set_parameter("a", 1).set_parameter(0, 2)
    assert q.get_parameters() == [2]
    q.set_parameter("b", 3, "integer")
    assert q.get_parameters() == {"b": 3} and q.get_parameter_type("b") == "integer" and q.get_parameter_type("c") == "string"
    assert q.create_named_parameter(1) == ":value1" and q.create_named_parameter(1, name=":x") == ":x"


def test_placeholders_outside_literals_only():
    text, args = compile_sql("SELECT '?', \":a\", `?`, x::int -- ?\n, ? /* :b */, ??", [7])
    assert text == "SELECT '?', \":a\", `?`, x::int -- ?\n, :p1 /* :b */, ?" and args == {"p1": 7}


def test_lists_expand_and_empty_lists_are_null():
    assert compile_sql("a IN (?) AND b IN (?)", [[1, 2], []]) == ("a IN (:p1_1, :p1_2) AND b IN (NULL)", {"p1_1": 1, "p1_2": 2})
    assert compile_sql("a IN (:l)", {"l": ["x"]}) == ("a IN (:l_1)", {"l_1": "x"})


def test_made_up_names_are_new(spark):
    text, args = compile_sql("x IN (:a) AND y = :a_1 AND z IN (:a)", {"a": [1, 2], "a_1": 9})
    assert args == {"a_1_": 1, "a_2": 2, "a_1": 9} and text == "x IN (:a_1_, :a_2) AND y = :a_1 AND z IN (:a_1_, :a_2)"
    q = QueryBuilder().set_parameter("value1", "mine")
    assert q.create_named_parameter("made") == ":value2" and q.get_parameters() == {"value1": "mine", "value2": "made"}


def test_changes_as_text_and_parts():
    q = QueryBuilder().insert("t").values({"a": "1"}).set_value("b", "?")
    assert sql(q) == "INSERT INTO t (a, b) VALUES (1, ?)" and q.change == ("INSERT", "t") and q.assignments == {"a": "1", "b": "?"}
    assert sql(QueryBuilder().update("t").set("a", "a + 1").where("b = 2")) == "UPDATE t SET a = a + 1 WHERE b = 2"
    assert sql(QueryBuilder().delete("t").where("x", "y")) == "DELETE FROM t WHERE (x) AND (y)"
    named = QueryBuilder().update_with("t", {"a": 5}, named=True)
    assert sql(named) == "UPDATE t SET a = :a" and named.get_parameters() == {"a": 5}
    for wrong in (lambda: QueryBuilder().insert("t").to_sql(), lambda: QueryBuilder().insert_with("t", {}), lambda: QueryBuilder().select("1").apply(None), lambda: q.to_df(None)):
        with pytest.raises(QueryError):
            wrong()
    q = QueryBuilder().select("a").distinct().from_("t", "u").join("u", "v", "w", "x").where("p").group_by("a").having("h").order_by("a", "DESC").set_max_results(3)
    assert (q.columns, q.is_distinct, q.sources, q.predicate, q.group_predicate, q.group_keys, q.order_keys, q.limits) == (("a",), True, (("t", "u"),), "p", "h", ("a",), ("a DESC",), (3, 0))
    assert q.joins[0][0] == "u" and q.joins[0][1].table == "v" and q.change is None and QueryBuilder().union("x").union_parts == (("", "x"),)


def test_six_positional_values_keep_their_order(spark):
    q = QueryBuilder().select(*[f"? AS c{i}" for i in range(8)]).set_parameters(list(range(8)))
    assert tuple(q.to_df(spark).first()) == tuple(range(8))


@pytest.mark.parametrize("text, params", [("?", []), (":a", {}), ("? ?", [1]), (":a", [1]), ("?", {"a": 1})])
def test_missing_parameters_raise(text, params):
    with pytest.raises(MissingParameter):
        compile_sql(text, params)


def test_spark_errors_become_ours(spark):
    with pytest.raises(TableNotFound):
        QueryBuilder().select("1").from_("no_such_table").to_df(spark)
    with pytest.raises(SyntaxErrorInQuery):
        QueryBuilder().select("1 1 1").to_df(spark)
    with pytest.raises(InvalidFieldName):
        QueryBuilder().select("nope").from_("range(1)").to_df(spark)


@pytest.mark.parametrize(
    "text, value",
    [
        (e.locate("'seawater'", "'water'"), 4), (e.locate("'tide'", "'tide'"), 1), (e.locate("'tide'", "'ebb'"), 0), (e.locate("'ebbandebb'", "'ebb'", 2), 7), (e.locate("'ebbandebb'", "'ebb'", 8), 0), (e.locate("'ebbandebb'", "'b'", "2 + 2"), 8),
        (e.substring("'lighthouse'", 6), "house"), (e.substring("'lighthouse'", 1, 5), "light"), (e.substring("'lighthouse'", "3 - 1", "2 * 2"), "ight"),
        (e.length("'Größe 7'"), 7), (e.length("'καλημέρα'"), 8), (e.length("'海の水'"), 3), (e.length("'🌊🌊'"), 2),
        (e.concat("'ebb'", "'&'", "'flow'"), "ebb&flow"), (e.concat("12", "'/'", "2031"), "12/2031"), (e.mod("17", "6"), 5), (e.bit_and("12", "10"), 8), (e.bit_or("12", "3"), 15),
        (e.date_diff("timestamp '2031-08-20 22:15:00'", "timestamp '2031-08-20 00:30:00'"), 0), (e.date_diff("timestamp '2031-09-02 00:10:00'", "timestamp '2031-08-30 23:50:00'"), 3),
        (e.trim("'  reef '"), "reef"), (e.trim("' reef  '", "LEADING"), "reef  "), (e.trim("' reef  '", "TRAILING"), " reef"), (e.trim("'xxreefx'", "BOTH", "'x'"), "reef"), (e.trim("'xxreefx'", "TRAILING", "'x'"), "xxreef"), (e.trim("' reef '", "BOTH", "'x'"), " reef "),
        (e.like(e.quote_string("100%_sure \\ {maybe} 'no'"), e.quote_string(e.escape_like("100%_sure \\ {maybe} 'no'", "#")), "#"), True), (e.like(e.quote_string("100 per_sure"), e.quote_string(e.escape_like("100%_sure", "#")), "#"), False),
    ],
)
def test_scalar_cases(spark, text, value):
    assert spark.sql(f"SELECT {text}").first()[0] == value


@pytest.mark.parametrize(
    "unit, n, added, taken",
    [
        ("SECOND", 75, "2031-03-30 21:46:20", "2031-03-30 21:43:50"), ("MINUTE", 20, "2031-03-30 22:05:05", "2031-03-30 21:25:05"), ("HOUR", 5, "2031-03-31 02:45:05", "2031-03-30 16:45:05"), ("DAY", 33, "2031-05-02 21:45:05", "2031-02-25 21:45:05"),
        ("WEEK", 2, "2031-04-13 21:45:05", "2031-03-16 21:45:05"), ("MONTH", 1, "2031-04-30 21:45:05", "2031-02-28 21:45:05"), ("QUARTER", 2, "2031-09-30 21:45:05", "2030-09-30 21:45:05"), ("YEAR", 3, "2034-03-30 21:45:05", "2028-03-30 21:45:05"),
    ],
)
@pytest.mark.parametrize("style", ["literal", "bound", "expression"])
def test_date_arithmetic(spark, unit, n, added, taken, style):
    amount, args = {"literal": (str(n), {}), "bound": (":n", {"n": n}), "expression": (f"0 + {n}", {})}[style]
    t = "timestamp_ntz '2031-03-30 21:45:05'"
    row = spark.sql(f"SELECT {e.add_interval(t, amount, unit)}, {e.sub_interval(t, amount, unit)}", args=args).first()
    assert [str(x) for x in row] == [added, taken]


def test_unknown_units_and_modes_raise():
    with pytest.raises(NotSupported):
        e.add_interval("x", 1, "CENTURY")
    with pytest.raises(NotSupported):
        e.trim("x", "MIDDLE")


def test_quoting():
    assert e.quote_identifier("a.b`c") == "`a`.`b``c`"


def test_quoted_strings_read_back(spark):
    text = "it's a \\ \"test\""
    assert spark.sql(f"SELECT {e.quote_string(text)}").first()[0] == text
