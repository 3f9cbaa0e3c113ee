"""Registered queries over the reference tables, built with the query builder.

Rows that the tables lack (nulls, unmatched keys, wildcards, blanks) are derived inside
both the query and its oracle. Sums of doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import exprs as e
from tidewater.functions.types import get_type
from tidewater.operators import portability, sqltext
from tidewater.operators.builder import QueryBuilder
from tidewater.plans.registry import register
from tidewater.sources import catalog
from tidewater.streaming.rollups import rollup


def built(name: str, tables: str, oracle: str) -> Callable[[Callable[[], QueryBuilder]], Callable[[], QueryBuilder]]:
    """Register a function that makes a builder over the named tables."""

    def add(make: Callable[[], QueryBuilder]) -> Callable[[], QueryBuilder]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            catalog.register(spark, sf_dir, tuple(tables.split()))
            return make().to_df(spark)

        register(name, oracle)(run)
        return make

    return add


@built(
    "segment_orders",
    "customer orders",
    """SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000.0 GROUP BY c_mktsegment HAVING count(*) > 10
ORDER BY segment LIMIT 10""",
)
def segment_orders() -> QueryBuilder:
    q = QueryBuilder()
    q.select("c.c_mktsegment AS segment", "count(*) AS n_orders", "round(sum(o.o_totalprice), 2) AS revenue")
    q.from_("customer", "c").inner_join("c", "orders", "o", e.eq("o.o_custkey", "c.c_custkey"))
    q.where(e.gt("o.o_totalprice", q.create_named_parameter(1000.0, "float"))).group_by("c.c_mktsegment")
    return q.having(e.gt("count(*)", q.create_named_parameter(10, "integer"))).order_by("segment", "ASC NULLS LAST").set_max_results(10)


@built(
    "project_filter_and_or",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem
WHERE ((l_quantity > 45 AND l_discount >= 0.05) OR l_returnflag = 'R') AND l_linenumber < 4""",
)
def project_filter_and_or() -> QueryBuilder:
    q = QueryBuilder().select("l_orderkey", "l_linenumber").add_select("l_partkey", "l_extendedprice * (1 - l_discount) AS net").from_("lineitem")
    q.where(e.gt("l_quantity", "?")).and_where(e.gte("l_discount", "?")).or_where(e.eq("l_returnflag", "?")).and_where(e.lt("l_linenumber", "?"))
    return q.set_parameters([45, 0.05, "R", 4], {0: "integer", 1: "float", 2: "string", 3: "integer"})


@built(
    "six_parameters",
    "part",
    "SELECT p_partkey, 1 AS a, 2 AS b, 3 AS c, 4 AS d, 5 AS e, 6 AS f FROM part WHERE p_size IN (1, 2, 3, 4, 5, 6)",
)
def six_parameters() -> QueryBuilder:
    q = QueryBuilder().select("p_partkey", *[f"? AS {n}" for n in "abcdef"]).from_("part").where(e.in_("p_size", ["?"] * 6))
    return q.set_parameters([1, 2, 3, 4, 5, 6] * 2)


@built("distinct_projection", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_projection() -> QueryBuilder:
    return QueryBuilder().select("o_orderstatus", "o_orderpriority").distinct().from_("orders")


@built(
    "inner_join_tree",
    "customer orders nation region",
    """SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN orders o ON o.o_custkey = c.c_custkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r_name, n_name""",
)
def inner_join_tree() -> QueryBuilder:
    q = QueryBuilder().select("r.r_name", "n.n_name", "count(*) AS n", "round(sum(o.o_totalprice), 2) AS total").from_("customer", "c")
    q.join("c", "nation", "n", "n.n_nationkey = c.c_nationkey").join("n", "region", "r", "r.r_regionkey = n.n_regionkey")
    return q.join("c", "orders", "o", "o.o_custkey = c.c_custkey").group_by("r.r_name").add_group_by("n.n_name")


@built(
    "left_join_null_filter",
    "customer orders",
    """SELECT c_custkey, c_name FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL""",
)
def left_join_null_filter() -> QueryBuilder:
    q = QueryBuilder()
    sub = q.sub().select("*").from_("orders").where(e.gt("o_totalprice", q.create_named_parameter(300000, "integer", "least")))
    q.select("c_custkey", "c_name").from_("customer", "c").left_join("c", f"({sub})", "o", e.eq("o.o_custkey", "c.c_custkey"))
    return q.where(e.is_null("o.o_orderkey"))


@built(
    "right_join",
    "orders customer",
    """SELECT c.c_custkey, count(o.o_orderkey) AS n FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000) o
RIGHT JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""",
)
def right_join() -> QueryBuilder:
    q = QueryBuilder()
    sub = q.sub().select("*").from_("orders").where(e.eq("o_orderpriority", "'1-URGENT'")).and_where(e.gt("o_totalprice", "250000"))
    return q.select("c.c_custkey", "count(o.o_orderkey) AS n").from_(f"({sub})", "o").right_join("o", "customer", "c", "c.c_custkey = o.o_custkey").group_by("c.c_custkey")


@built("comma_join", "nation region", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def comma_join() -> QueryBuilder:
    return QueryBuilder().select("n_name", "r_name").from_("nation").from_("region").where("n_regionkey = r_regionkey")


@built("inner_join_no_condition", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def inner_join_no_condition() -> QueryBuilder:
    """The reference's join without ON; both tables are fixed and tiny."""
    return QueryBuilder().select("r.r_name", "n.n_name").from_("region", "r").inner_join("r", "nation", "n")


@built(
    "theta_join",
    "nation region",
    "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > r.r_regionkey * 3",
)
def theta_join() -> QueryBuilder:
    q = QueryBuilder().select("n.n_nationkey", "r.r_regionkey").from_("nation", "n")
    return q.inner_join("n", "region", "r", e.and_("n.n_regionkey = r.r_regionkey", e.gt("n.n_nationkey", "r.r_regionkey * 3")))


@built(
    "exists_subquery",
    "customer orders",
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000)",
)
def exists_subquery() -> QueryBuilder:
    sub = QueryBuilder().select("1").from_("orders", "o").where("o.o_custkey = c.c_custkey", "o.o_totalprice > 350000")
    return QueryBuilder().select("c_custkey").from_("customer", "c").where(f"EXISTS ({sub})")


@built(
    "anti_join",
    "part lineitem",
    "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)",
)
def anti_join() -> QueryBuilder:
    sub = QueryBuilder().select("1").from_("lineitem").where("l_partkey = p_partkey", "l_quantity > 48")
    return QueryBuilder().select("p_partkey").from_("part").where(f"NOT EXISTS ({sub})")


@built(
    "scalar_subquery",
    "part",
    "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
)
def scalar_subquery() -> QueryBuilder:
    sub = QueryBuilder().select("avg(p_retailprice)").from_("part")
    return QueryBuilder().select("p_partkey", "p_retailprice").from_("part").where(e.gt("p_retailprice", f"({sub})"))


@built(
    "group_having",
    "orders",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders
GROUP BY o_orderpriority, o_orderstatus HAVING count(*) > 100 OR max(o_totalprice) > 400000""",
)
def group_having() -> QueryBuilder:
    q = QueryBuilder().select("o_orderpriority", "o_orderstatus", "count(*) AS n", "round(avg(o_totalprice), 4) AS mean").from_("orders")
    return q.group_by("o_orderpriority", "o_orderstatus").having("count(*) > 100").or_having("max(o_totalprice) > 400000")


@built(
    "top_k_offset",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 5 OFFSET 10",
)
def top_k_offset() -> QueryBuilder:
    q = QueryBuilder().select("o_orderkey", "o_totalprice").from_("orders").order_by("o_totalprice", "DESC NULLS LAST")
    return q.add_order_by("o_orderkey", "ASC NULLS LAST").set_max_results(5).set_first_result(10)


@built("offset_only", "nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey NULLS LAST OFFSET 20")
def offset_only() -> QueryBuilder:
    return QueryBuilder().select("n_nationkey").from_("nation").order_by("n_nationkey", "ASC NULLS LAST").set_first_result(20)


@built("no_from", "", "SELECT 1 AS one, 'a' AS letter")
def no_from() -> QueryBuilder:
    return QueryBuilder().select("1 AS one", "'a' AS letter")


_LOW = "SELECT o_custkey FROM orders WHERE o_totalprice < 20000"
_HIGH = "SELECT o_custkey FROM orders WHERE o_totalprice > 300000"


def _part(condition: str) -> QueryBuilder:
    return QueryBuilder().select("o_custkey").from_("orders").where(condition)


@built("union_distinct", "orders", f"{_LOW} UNION {_HIGH}")
def union_distinct() -> QueryBuilder:
    return QueryBuilder().union(_part("o_totalprice < 20000")).add_union(_part("o_totalprice > 300000"))


@built("union_all", "orders", f"{_LOW} UNION ALL {_HIGH}")
def union_all() -> QueryBuilder:
    return QueryBuilder().union(_part("o_totalprice < 20000")).add_union(_part("o_totalprice > 300000"), every=True)


@built("union_mixed", "orders", f"SELECT * FROM ({_LOW} UNION {_LOW}) UNION ALL {_LOW}")
def union_mixed() -> QueryBuilder:
    low = _part("o_totalprice < 20000")
    return QueryBuilder().union(low).add_union(low).add_union(low, every=True)


@built("union_order_limit", "orders", f"SELECT * FROM ({_LOW} UNION {_HIGH}) ORDER BY o_custkey NULLS LAST LIMIT 7 OFFSET 2")
def union_order_limit() -> QueryBuilder:
    q = QueryBuilder().union(_part("o_totalprice < 20000")).add_union(_part("o_totalprice > 300000"))
    return q.order_by("o_custkey", "ASC NULLS LAST").set_max_results(7).set_first_result(2)


@built(
    "cte_columns",
    "orders",
    "WITH spent (cust, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT cust, round(total, 2) AS total FROM spent WHERE total > 500000",
)
def cte_columns() -> QueryBuilder:
    q = QueryBuilder()
    part = q.sub().select("o_custkey", "sum(o_totalprice)").from_("orders").where(e.eq("o_orderstatus", q.create_named_parameter("F"))).group_by("o_custkey")
    return q.with_("spent", part, ("cust", "total")).select("cust", "round(total, 2) AS total").from_("spent").where(e.gt("total", q.create_named_parameter(500000, "integer")))


@built(
    "cte_in_union",
    "orders",
    "WITH big AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 350000) SELECT o_orderkey FROM big UNION ALL SELECT o_orderkey FROM big WHERE o_orderkey % 2 = 0",
)
def cte_in_union() -> QueryBuilder:
    big = QueryBuilder().select("o_orderkey").from_("big")
    even = QueryBuilder().select("o_orderkey").from_("big").where("o_orderkey % 2 = 0")
    return QueryBuilder().with_("big", "SELECT o_orderkey FROM orders WHERE o_totalprice > 350000").union(big).add_union(even, every=True)


@built("in_list_param", "part", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#32') AND p_size NOT IN (1, 2, 3)")
def in_list_param() -> QueryBuilder:
    q = QueryBuilder().select("p_partkey", "p_brand").from_("part").where(e.in_("p_brand", ":brands"), e.not_in("p_size", ":sizes"))
    return q.set_parameters({"brands": ["Brand#11", "Brand#23", "Brand#32"], "sizes": [1, 2, 3]})


@built("in_empty_list", "part", "SELECT p_partkey FROM part WHERE p_size IN (NULL)")
def in_empty_list() -> QueryBuilder:
    return QueryBuilder().select("p_partkey").from_("part").where(e.in_("p_size", "?")).set_parameters([[]])


@built("not_in_empty_list", "part", "SELECT p_partkey FROM part WHERE p_size NOT IN (NULL)")
def not_in_empty_list() -> QueryBuilder:
    return QueryBuilder().select("p_partkey").from_("part").where(e.not_in("p_size", "?")).set_parameters([[]])


@built(
    "like_escape",
    "part",
    r"SELECT p_partkey FROM part WHERE (CASE WHEN p_partkey % 3 = 0 THEN '50%_more: ' || p_name ELSE p_name END) LIKE '50#%#_more%' ESCAPE '#' AND p_type NOT LIKE '%TIN'",
)
def like_escape() -> QueryBuilder:
    q = QueryBuilder().select("p_partkey").from_("part")
    pattern = q.create_named_parameter(e.escape_like("50%_more", "#") + "%")
    q.where(e.like("CASE WHEN p_partkey % 3 = 0 THEN concat('50%_more: ', p_name) ELSE p_name END", pattern, "#"))
    return q.and_where(e.not_like("p_type", q.create_named_parameter("%TIN")))


@built("regexp", "part", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]2$')")
def regexp() -> QueryBuilder:
    q = QueryBuilder().select("p_partkey").from_("part")
    return q.where(e.regexp("p_brand", q.create_named_parameter("^Brand#[1-3]2$")))


@built(
    "trim_modes",
    "part",
    """SELECT p_partkey, trim(s) AS both_space, ltrim(s) AS lead_space, rtrim(s) AS trail_space, trim(p_brand, 'B2') AS both_chars, ltrim(p_brand, 'Bra') AS lead_chars, rtrim(p_brand, '123') AS trail_chars
FROM (SELECT *, '  ' || p_brand || ' ' AS s FROM part)""",
)
def trim_modes() -> QueryBuilder:
    s = "concat('  ', p_brand, ' ')"
    q = QueryBuilder().select("p_partkey", f"{e.trim(s)} AS both_space", f"{e.trim(s, 'LEADING')} AS lead_space", f"{e.trim(s, 'TRAILING')} AS trail_space")
    q.add_select(f"{e.trim('p_brand', 'BOTH', ':edge')} AS both_chars", f"{e.trim('p_brand', 'LEADING', ':lead')} AS lead_chars", f"{e.trim('p_brand', 'TRAILING', ':trail')} AS trail_chars")
    return q.from_("part").set_parameters({"edge": "B2", "lead": "Bra", "trail": "123"})


@built(
    "string_functions",
    "part",
    """SELECT p_partkey, instr(p_name, 'a') AS at, CASE WHEN instr(p_name[4:], 'a') = 0 THEN 0 ELSE instr(p_name[4:], 'a') + 3 END AS later, substr(p_name, 3) AS rest,
substr(p_name, 2, 4) AS part, p_brand || '-' || p_size AS label, length('Größe ' || p_brand || '🌊') AS n FROM part""",
)
def string_functions() -> QueryBuilder:
    q = QueryBuilder().select("p_partkey", f"{e.locate('p_name', ':a')} AS at", f"{e.locate('p_name', ':a', '1 + 3')} AS later", f"{e.substring('p_name', 3)} AS rest")
    q.add_select(f"{e.substring('p_name', '1 + 1', '2 + 2')} AS part", f"{e.concat('p_brand', ':dash', 'p_size')} AS label", f"{e.length(e.concat(':hello', 'p_brand', ':last'))} AS n")
    return q.from_("part").set_parameters({"a": "a", "dash": "-", "hello": "Größe ", "last": "🌊"})


@built("mod_bit", "part", "SELECT p_partkey, p_size % 7 AS m, -p_size % 7 AS neg, p_size & 6 AS band, p_size | 9 AS bor FROM part")
def mod_bit() -> QueryBuilder:
    return QueryBuilder().select("p_partkey", f"{e.mod('p_size', '7')} AS m", f"{e.mod('-p_size', '7')} AS neg", f"{e.bit_and('p_size', '6')} AS band", f"{e.bit_or('p_size', '9')} AS bor").from_("part")


_STEPS = {"SECOND": 90, "MINUTE": 44, "HOUR": 31, "DAY": 17, "WEEK": 5, "MONTH": 7, "QUARTER": 2, "YEAR": 4}


def _moved(sign: str) -> str:
    step = {"QUARTER": ("MONTH", 3 * _STEPS["QUARTER"]), "WEEK": ("DAY", 7 * _STEPS["WEEK"])}
    columns = ", ".join(f"o_orderdate {sign} INTERVAL {n} {u} AS {unit.lower()}_moved" for unit, amount in _STEPS.items() for u, n in [step.get(unit, (unit, amount))])
    return f"SELECT o_orderkey, {columns} FROM orders"


@built("date_add_units", "orders", _moved("+"))
def date_add_units() -> QueryBuilder:
    q = QueryBuilder().select("o_orderkey").from_("orders")
    return q.add_select(*[f"{e.add_interval('o_orderdate', q.create_named_parameter(n, 'integer'), u)} AS {u.lower()}_moved" for u, n in _STEPS.items()])


@built("date_sub_units", "orders", _moved("-"))
def date_sub_units() -> QueryBuilder:
    q = QueryBuilder().select("o_orderkey").from_("orders")
    return q.add_select(*[f"{e.sub_interval('o_orderdate', f'0 + {n}', u)} AS {u.lower()}_moved" for u, n in _STEPS.items()])


@built(
    "date_column_interval",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, l_shipdate + to_days(l_linenumber) AS due, date_diff('day', l_shipdate::DATE, DATE '1998-12-01') AS age FROM lineitem",
)
def date_column_interval() -> QueryBuilder:
    return QueryBuilder().select("l_orderkey", "l_linenumber", f"{e.add_interval('l_shipdate', 'l_linenumber', 'DAY')} AS due", f"{e.date_diff('to_date(:until)', 'l_shipdate')} AS age").from_("lineitem").set_parameter("until", "1998-12-01")


@built(
    "comparisons_null",
    "customer",
    """SELECT c_custkey, b IS NULL AS missing, b IS NOT NULL AS there, b = 100 AS same, b <> 100 AS other, b < 100 AS less, b <= 100 AS most, b > 100 AS more, b >= 100 AS least
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS b FROM customer)""",
)
def comparisons_null() -> QueryBuilder:
    sub = QueryBuilder().select("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS b").from_("customer")
    q = QueryBuilder().select("c_custkey", f"{e.is_null('b')} AS missing", f"{e.is_not_null('b')} AS there").from_(f"({sub})", "x")
    pairs = ((e.eq, "same"), (e.neq, "other"), (e.lt, "less"), (e.lte, "most"), (e.gt, "more"), (e.gte, "least"))
    return q.add_select(*[f"{f('b', ':bound')} AS {name}" for f, name in pairs]).set_parameter("bound", 100)


@built(
    "window_functions",
    "orders",
    """SELECT o_orderkey, row_number() OVER w AS n, lag(o_orderkey) OVER w AS before, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus NULLS LAST) AS kind
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST)""",
)
def window_functions() -> QueryBuilder:
    """Windows pass through a slot as text (beyond parity as an operator)."""
    w = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST)"
    q = QueryBuilder().select("o_orderkey", f"row_number() {w} AS n", f"lag(o_orderkey) {w} AS before")
    return q.add_select("dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus ASC NULLS LAST) AS kind").from_("orders")


@built(
    "rollup_groups",
    "lineitem",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def rollup_groups() -> QueryBuilder:
    q = QueryBuilder().select("l_returnflag", "l_linestatus", "count(*) AS n", "sum(l_linenumber) AS lines", "count(DISTINCT l_suppkey) AS suppliers")
    return q.from_("lineitem").group_by("ROLLUP (l_returnflag, l_linestatus)")


@built(
    "pricing_summary",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary() -> QueryBuilder:
    q = QueryBuilder().select("l_returnflag", "l_linestatus", "round(sum(l_quantity), 2) AS qty", "round(sum(l_extendedprice), 2) AS base")
    q.add_select("round(sum(l_extendedprice * (1 - l_discount)), 2) AS net", "round(avg(l_discount), 6) AS discount", "count(*) AS n").from_("lineitem")
    return q.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").group_by("l_returnflag", "l_linestatus")


_TEXTS = "CASE WHEN conv_id % 7 = 0 THEN '' WHEN conv_id % 7 = 1 THEN '   ' WHEN conv_id % 7 = 2 THEN text || '  ' || chr(9) ELSE text END"


@register(
    "portability_trim_empty",
    f"SELECT conv_id, turn, regexp_replace(nullif(t, ''), '[ \\t\\n\\v\\f\\r]+$', '') AS text FROM (SELECT conv_id, turn, {_TEXTS} AS t FROM conversations)",
)
def portability_trim_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.read(spark, "parquet", f"{sf_dir}/conversations.parquet")
    return portability.normalise(rows.selectExpr("CONV_ID", "turn", f"{_TEXTS} AS Text"))


@register(
    "simple_array_type",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN [] ELSE string_split(p_brand || ',' || p_type, ',') END AS tags FROM part",
)
def simple_array_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.read(spark, "parquet", f"{sf_dir}/part.parquet")
    stored = F.when(F.col("p_partkey") % 8 == 0, F.lit("")).when(F.col("p_partkey") % 4 != 0, F.concat_ws(",", "p_brand", "p_type"))
    return rows.select("p_partkey", get_type("simple_array").decode(stored).alias("tags"))


_CODECS = """SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate AS moment, o_orderkey % 2 = 1 AS odd, CAST(o_totalprice AS DECIMAL(12,2))::VARCHAR AS price, (o_orderkey % 30000)::SMALLINT AS small
FROM orders"""


@register("type_codecs", _CODECS)
@register("type_codecs_all", _CODECS)
def type_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders through the codecs; the smallint is a remainder that fits."""
    rows = catalog.read(spark, "parquet", f"{sf_dir}/orders.parquet")
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "o_orderkey",
        get_type("date").decode(F.substring(text, 1, 10)).alias("day"),
        get_type("datetime").decode(text).alias("moment"),
        get_type("boolean").decode((F.col("o_orderkey") % 2).cast("int")).alias("odd"),
        get_type("decimal").decode(F.col("o_totalprice").cast("decimal(12,2)")).alias("price"),
        get_type("smallint").decode((F.col("o_orderkey") % 30000).cast("string")).alias("small"),
    )


@register(
    "sql_text_shape",
    "SELECT event_id, 'SELECT * FROM EVENTS WHERE USER_ID = ? AND TYPE = ?' AS shape, 'SELECT * FROM events WHERE user_id = ' || user_id || ' AND type = ''' || event_type || '''' AS compressed FROM events",
)
def sql_text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as a query log holds them, with comments, line ends and values."""
    rows = catalog.read(spark, "parquet", f"{sf_dir}/events.parquet")
    sql = F.concat(F.lit("SELECT *\n  FROM events -- all\n WHERE user_id = "), "user_id", F.lit(" /* one */ AND  type = '"), "event_type", F.lit("'\n"))
    return rows.select("event_id", sqltext.shape(sql).alias("shape"), sqltext.compress(sql).alias("compressed"))


@register(
    "event_rollup",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""",
)
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup(catalog.read(spark, "parquet", f"{sf_dir}/events.parquet"))
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "event_type", "n", F.round("total", 4).alias("total"))
