"""One query for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import functions as fn
from .. import streaming
from .. import sources
from ..operators import aggregates, graph, joins, query, search, shards, temporal, validate
from ..operators.collection import Database
from ..operators.logged import LoggedCollection
from ..operators.query import ColumnView, Query
from ..sources import table
from ..storage import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_query(name: str, statement: str, oracle: str | None = None) -> None:
    """A query in SQL over temporary views of the tables that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if t in statement:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(statement)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = oracle or statement


def q(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return Query(table(spark, sf_dir, name))


# --- filters and projections ---------------------------------------------------------------------------------------


@register("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY n_name ORDER BY total DESC, n_name LIMIT 10")
def flagship(spark, d):
    orders = q(spark, d, "orders").where("o_orderstatus", "eq", "F").where("o_totalprice", "gt", 100000).df
    both = joins.chain(orders, (table(spark, d, "customer"), "o_custkey", "c_custkey", "inner"), (table(spark, d, "nation"), "c_nationkey", "n_nationkey", "inner"))
    out = both.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.orderBy(F.col("total").desc(), "n_name").limit(10)


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F'")
def where_eq(spark, d):
    return q(spark, d, "orders").where("o_orderstatus", "eq", "F").select("o_orderkey", "o_totalprice").df


@register("SELECT o_orderkey, s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) WHERE s IS DISTINCT FROM 'F'")
def where_ne(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("s"))
    return Query(rows).where("s", "ne", "F").df


@register("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal < 5000")
def where_gt_lt(spark, d):
    return q(spark, d, "customer").where("c_acctbal", "gt", 1000).where("c_acctbal", "lt", 5000).select("c_custkey", "c_acctbal").df


@register("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20")
def where_gte_lte(spark, d):
    return q(spark, d, "part").where("p_size", "gte", 10).where("p_size", "lte", 20).select("p_partkey", "p_size").df


@register("SELECT p_partkey, s FROM (SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE p_size END AS s, p_brand FROM part) WHERE (s IS NULL OR s NOT IN (1, 2, 3)) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
def where_in_nin(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") != 7, F.col("p_size")).alias("s"), "p_brand")
    return Query(rows).where("s", "nin", [1, 2, 3]).where("p_brand", "in", ["Brand#11", "Brand#12", "Brand#23"]).select("p_partkey", "s").df


@register("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def where_between(spark, d):
    return q(spark, d, "lineitem").where("l_quantity", "between", [10, 12]).select("l_orderkey", "l_quantity").df


@register("SELECT p_partkey FROM part WHERE p_size <> 7")
def where_exists(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") != 7, F.col("p_size")).alias("s"))
    return Query(rows).where("s", "exists", True).select("p_partkey").df


@register("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND contains(lower(p_type), 'eco')")
def where_contains(spark, d):
    return q(spark, d, "part").where("p_name", "contains", "a").where("p_type", "icontains", "ECO").select("p_partkey", "p_name").df


@register("SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') AND ends_with(p_brand, '2')")
def where_starts_ends(spark, d):
    return q(spark, d, "part").where("p_brand", "startswith", "Brand#1").where("p_brand", "endswith", "2").select("p_partkey").df


@register("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def where_regex(spark, d):
    return q(spark, d, "documents").where("text", "regex", "[0-9]{3}-[0-9]{4}").select("doc_id").df


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_discount > 4")
def where_fn(spark, d):
    return q(spark, d, "lineitem").where_fn(lambda df: df["l_quantity"] * df["l_discount"] > 4).select("l_orderkey", "l_linenumber").df


@register("SELECT o_orderkey FROM orders WHERE false")
def where_type_mismatch(spark, d):
    return q(spark, d, "orders").where("o_totalprice", "gt", "high").select("o_orderkey").df


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice <= 60000")
def range_scan(spark, d):
    return query.between(table(spark, d, "orders"), "o_totalprice", 50000, 60000).select("o_orderkey", "o_totalprice")


@register("SELECT p_partkey FROM part WHERE starts_with(CAST(p_partkey AS VARCHAR), '12')")
def prefix_scan(spark, d):
    return query.prefix(table(spark, d, "part"), "p_partkey", "12").select("p_partkey")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, d):
    return query.point(table(spark, d, "customer"), "c_custkey", 42).select("c_custkey", "c_name")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 99, 3)")
def multi_get(spark, d):
    return query.multi(table(spark, d, "customer"), "c_custkey", [99, 5, 3, -1]).select("c_custkey", "c_name")


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_project(spark, d):
    return q(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").df


@register("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_field(spark, d):
    return q(spark, d, "customer").distinct("c_mktsegment")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def order_limit_skip(spark, d):
    return q(spark, d, "orders").order_by("o_orderkey").order_by("o_totalprice", desc=True).skip(10).limit(20).select("o_orderkey", "o_totalprice").df


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_path(spark, d):
    rows = table(spark, d, "events").withColumn("data", F.from_json("props", "k long"))
    return Query(rows).where("data.k", "gt", 50).df.select("event_id", F.col("data.k").alias("k"))


# --- SQL -----------------------------------------------------------------------------------------------------------

sql_query("sql_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
sql_query("sql_case_coalesce", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END AS c, coalesce(nullif(p_size, 7), -1) AS s FROM part")
sql_query("sql_like_in_between_null", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_size IN (1, 5, 9) AND p_retailprice BETWEEN 900 AND 1500 AND p_brand IS NOT NULL AND NOT (p_type LIKE 'X%')")
sql_query("sql_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
sql_query("sql_count_distinct", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS s, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS t FROM lineitem")
sql_query("sql_min_max", "SELECT l_returnflag, min(l_shipdate) AS first_day, max(l_extendedprice) AS most, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag")
sql_query("sql_order_offset", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 15 OFFSET 5")
sql_query("sql_no_from", "SELECT 1 + 1 AS two, upper('a') AS a")
sql_query("sql_join_inner", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
sql_query("sql_join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")
sql_query("sql_join_right", "SELECT c_custkey, n_name FROM (SELECT * FROM customer WHERE c_nationkey < 5) c RIGHT JOIN nation ON c_nationkey = n_nationkey")
sql_query("sql_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 0)")
sql_query("union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey AS k FROM customer")
sql_query("union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey AS k FROM customer")
sql_query("intersect_keys", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0")
sql_query("except_keys", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000")


@register("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, substr(p_name, 3, 4) AS s, substr(p_name, -3) AS e, p_brand || '/' || p_type AS c, trim('  ' || p_type || ' ') AS t, replace(p_type, 'E', '3') AS r FROM part")
def sql_string_funcs(spark, d):
    p = table(spark, d, "part")
    name = F.col("p_name")
    padded = F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))
    return p.select(
        "p_partkey", F.upper(name).alias("u"), F.lower("p_brand").alias("l"), fn.length(name).cast("long").alias("n"), fn.substr(name, 2, 4).alias("s"), fn.substr(name, -3).alias("e"),
        fn.concat(F.col("p_brand"), F.lit("/"), F.lit(None).cast("string"), F.col("p_type")).alias("c"), fn.trim(padded).alias("t"), fn.replace(F.col("p_type"), "E", "3").alias("r"),
    )


@register("SELECT p_partkey, abs(p_size - 25) AS a, round(CAST(p_size AS DOUBLE) / 7, 4) AS q FROM part")
def sql_math_funcs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.abs(F.col("p_size") - 25).alias("a"), fn.round_half_even(F.col("p_size").cast("double") / 7, 4).alias("q"))


@register("""
WITH t AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size - 20 END AS a, p_size % 4 - 1 AS b FROM part)
SELECT p_partkey, coalesce(a, 0) + b AS s, coalesce(a, 0) - b AS m, coalesce(a, 0) * b AS p, CAST(coalesce(a, 0) AS DOUBLE) / coalesce(nullif(b, 0), 1) AS d,
       CAST(coalesce(a, 0) - coalesce(nullif(b, 0), 1) * floor(CAST(coalesce(a, 0) AS DOUBLE) / coalesce(nullif(b, 0), 1)) AS INTEGER) AS r FROM t""")
def safe_arith(spark, d):
    size = F.col("p_size")
    t = table(spark, d, "part").select("p_partkey", F.when(size % 5 != 0, size - 20).alias("a"), (size % 4 - 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.select("p_partkey", fn.add(a, b).alias("s"), fn.subtract(a, b).alias("m"), fn.multiply(a, b).alias("p"), fn.divide(a, b).alias("d"), fn.modulo(a, b).alias("r"))


@register("SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%'")
def where_like(spark, d):
    return table(spark, d, "part").filter(fn.like(F.col("p_name"), "%a_e%")).select("p_partkey")


_BRANDS = "(SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE p_brand END AS b, CASE WHEN p_size = 7 THEN NULL ELSE p_size END AS s FROM part)"


def _brands(spark, d):
    some = F.col("p_size") != 7
    return table(spark, d, "part").select("p_partkey", F.when(some, F.col("p_brand")).alias("b"), F.when(some, F.col("p_size")).alias("s"))


@register(f"SELECT p_partkey FROM {_BRANDS} WHERE b NOT LIKE 'Brand#1%'")
def where_not_like(spark, d):
    return _brands(spark, d).filter(fn.like(F.col("b"), "Brand#1%", negated=True)).select("p_partkey")


@register(f"SELECT p_partkey FROM {_BRANDS} WHERE NOT coalesce(s > 10, false) AND NOT coalesce(b = 'Brand#11', false)")
def where_not(spark, d):
    """Negated comparisons take nulls."""
    return Query(_brands(spark, d)).where_not("s", "gt", 10).where_not("b", "eq", "Brand#11").select("p_partkey").df


@register(f"SELECT p_partkey FROM {_BRANDS} WHERE NOT coalesce(s BETWEEN 5 AND 40, false)")
def where_not_between(spark, d):
    return Query(_brands(spark, d)).where_not("s", "between", [5, 40]).select("p_partkey").df


@register("SELECT c_custkey FROM customer WHERE contains('BUILDING or MACHINERY', c_mktsegment)")
def where_in_text(spark, d):
    return q(spark, d, "customer").where("c_mktsegment", "in", "BUILDING or MACHINERY").select("c_custkey").df


@register("SELECT c_custkey FROM customer WHERE starts_with(CAST(c_nationkey AS VARCHAR), '1')")
def where_text_of_number(spark, d):
    """Text predicates read numbers as text."""
    return q(spark, d, "customer").where("c_nationkey", "startswith", "1").select("c_custkey").df


@register(f"SELECT p_partkey, s FROM {_BRANDS} WHERE s IS NULL OR s < 3 ORDER BY s DESC NULLS FIRST, p_partkey LIMIT 40")
def order_nulls_first(spark, d):
    rows = _brands(spark, d).filter("s IS NULL OR s < 3")
    return Query(rows).order_by("p_partkey").order_by("s", desc=True).limit(40).select("p_partkey", "s").df


@register(f"SELECT p_partkey, s FROM {_BRANDS} ORDER BY s ASC NULLS LAST, p_partkey DESC LIMIT 25")
def order_then_where(spark, d):
    """A filter and a selection between sort keys leave the earlier key in force."""
    chain = Query(_brands(spark, d)).order_by("p_partkey", desc=True).select("p_partkey", "s").where("p_partkey", "gt", 0).order_by("s")
    return chain.limit(25).df


@register("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_rows(spark, d):
    rows = q(spark, d, "orders").find(o_orderstatus="F")
    return spark.createDataFrame([(rows.count(),)], "n long")


@register("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def find_by_fields(spark, d):
    return q(spark, d, "customer").find(c_mktsegment="BUILDING", c_nationkey=3).df.select("c_nationkey", "c_mktsegment").distinct()


@register("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def index_lookup(spark, d):
    """What a hash index answers; the predicate reaches the scan."""
    return Database(spark).register("customer", table(spark, d, "customer")).find_by("c_nationkey", 7).select("c_custkey")


@register("SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 60000")
def range_half_open(spark, d):
    return query.between(table(spark, d, "orders"), "o_totalprice", 50000, 60000, (True, False)).select("o_orderkey")


@register("SELECT min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM orders")
def key_ends(spark, d):
    return query.ends(table(spark, d, "orders"), "o_orderkey")


@register("SELECT user_id AS id, value FROM events WHERE event_type = 'click' AND value > 50")
def path_in_data_first(spark, d):
    """A field that record and data both have is data's; where data has null, the record's."""
    rows = table(spark, d, "events").withColumn("data", F.struct(F.col("user_id").alias("id"), F.when(F.col("event_type") == "click", F.lit("click")).alias("kind")))
    rows = rows.select(F.lit(-1).cast("long").alias("id"), F.lit("none").alias("kind"), "value", "data")
    return Query(rows).where("kind", "eq", "click").where("value", "gt", 50).select("id", "value").df


@register("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")
def where_fn_batches(spark, d):
    """A Python predicate over Arrow batches."""
    def dear(pdf):
        return pdf["o_totalprice"] > 150000

    dear.batches = True
    return Query(table(spark, d, "orders").select("o_orderkey", "o_totalprice")).where_fn(dear).select("o_orderkey").df


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 400000 AND o_orderstatus IN ('F', 'O')")
def column_filter(spark, d):
    view = ColumnView(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return view.filter("o_totalprice", "gt", 400000).filter("o_orderstatus", "in", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@register(f"SELECT p_partkey, coalesce(s > 25, false) AS match FROM {_BRANDS}")
def column_mask(spark, d):
    return ColumnView(_brands(spark, d)).mask("s", "gt", 25).select("p_partkey", "match")


def _column_groups() -> None:
    for op in ("sum", "avg", "min", "max"):
        def one(spark, d, op=op):
            rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("s"), "o_totalprice")
            return ColumnView(rows).group("s", "o_totalprice", op).select("s", F.round("value", 2).alias("value"))

        one.__name__ = f"column_group_{op}"
        register(f"SELECT coalesce(s, '__none__') AS s, round({op}(o_totalprice), 2) AS value FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s, o_totalprice FROM orders) GROUP BY 1")(one)


_column_groups()


# --- aggregates ----------------------------------------------------------------------------------------------------


@register("SELECT round(sum(l_quantity), 2) AS value FROM lineitem")
def agg_scalar(spark, d):
    return aggregates.scalar(table(spark, d, "lineitem"), "l_quantity", "sum").select(F.round("value", 2).alias("value"))


def _aggregates() -> None:
    """A query for each scalar and each grouped aggregate of the builder."""
    for op in ("avg", "min", "max", "count"):
        def one(spark, d, op=op):
            return aggregates.scalar(table(spark, d, "lineitem"), "l_quantity", op).select(F.round("value", 6).alias("value"))

        one.__name__ = f"agg_scalar_{op}"
        register(f"SELECT round({op}(l_quantity), 6) AS value FROM lineitem")(one)
    for op in ("sum", "min", "max", "count"):
        def groups(spark, d, op=op):
            return aggregates.grouped(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", op).select("l_returnflag", F.round("value", 2).alias("value"))

        groups.__name__ = f"group_by_{op}"
        register(f"SELECT l_returnflag, round({op}(l_extendedprice), 2) AS value FROM lineitem GROUP BY l_returnflag")(groups)


_aggregates()


@register("SELECT CAST(0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS mean, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity < 0")
def agg_of_nothing(spark, d):
    """Aggregates of no rows: sums are 0, a mean is null."""
    none = table(spark, d, "lineitem").filter("l_quantity < 0")
    total, mean = aggregates.scalar(none, "l_quantity", "sum").first()[0], aggregates.scalar(none, "l_quantity", "avg").first()[0]
    return spark.createDataFrame([(float(total), mean, none.count())], "total double, mean double, n long")


@register("""
SELECT r_regionkey, true AS intact FROM region WHERE r_regionkey <> 2 UNION ALL SELECT r_regionkey, false FROM region WHERE r_regionkey = 2""")
def record_verify(spark, d):
    """Checksums of stored records, one of which was changed since."""
    kept = table(spark, d, "region").withColumn("sum", fn.checksum("r_regionkey", "r_name"))
    changed = kept.withColumn("r_name", F.when(F.col("r_regionkey") == 2, "changed").otherwise(F.col("r_name")))
    return aggregates.verified(changed, ["r_regionkey", "r_name"], F.col("sum")).select("r_regionkey", "intact")


@register("SELECT l_returnflag, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY l_returnflag")
def group_by_builder(spark, d):
    return aggregates.grouped(table(spark, d, "lineitem"), "l_returnflag", "l_discount", "avg").select("l_returnflag", F.round("value", 6).alias("value"))


@register("SELECT round(sum(l_tax), 4) AS sum, round(avg(l_tax), 6) AS avg, min(l_tax) AS min, max(l_tax) AS max, count(*) AS count, count(l_tax) AS count_field FROM lineitem")
def columnar_aggregate(spark, d):
    return aggregates.columnar(table(spark, d, "lineitem"), "l_tax").withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@register("SELECT coalesce(s, '__none__') AS s, count(*) AS value FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) GROUP BY 1")
def columnar_group_by(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("s"))
    return aggregates.grouped(rows, "s", none_label="__none__")


@register("""
SELECT 'o_orderstatus' AS field, count(*) AS total_rows, count(DISTINCT o_orderstatus) AS "distinct", count(DISTINCT o_orderstatus) / count(*) AS selectivity, min(o_orderstatus) AS least, max(o_orderstatus) AS greatest FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), count(DISTINCT o_custkey) / count(*), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders""")
def field_stats(spark, d):
    return aggregates.field_stats(table(spark, d, "orders"), ["o_orderstatus", "o_custkey"], exact=True)


@register("""
WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, v[1] AS least, v[n] AS greatest, v[least(CAST(floor(n * 0.5) AS BIGINT) + 1, n)] AS p50, v[least(CAST(floor(n * 0.95) AS BIGINT) + 1, n)] AS p95, v[least(CAST(floor(n * 0.99) AS BIGINT) + 1, n)] AS p99 FROM s""")
def latency_percentiles(spark, d):
    return aggregates.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register("""SELECT r_regionkey, substr(sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}'), 1, 16) AS h FROM region""")
def record_checksum(spark, d):
    return table(spark, d, "region").select("r_regionkey", fn.checksum("r_regionkey", "r_name", algorithm="sha256").alias("h"))


# --- joins ---------------------------------------------------------------------------------------------------------


def _customers_orders(spark, d, how, floor=150000):
    """All customers; only orders above the floor, so that some customers have none."""
    return joins.nested(table(spark, d, "customer"), table(spark, d, "orders").filter(F.col("o_totalprice") > floor), ("c_custkey", "o_custkey"), how, "orders", "o_orderkey")


_ORDERS = "o AS (SELECT * FROM orders WHERE o_totalprice > 150000), c AS (SELECT * FROM customer)"


@register(f"""
WITH {_ORDERS} SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, coalesce(min(o_orderkey), -1) AS first_order
FROM c LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey""")
def join_nested_left(spark, d):
    j = _customers_orders(spark, d, "left")
    total = F.aggregate(fn.array_path(F.col("orders"), "o_totalprice"), F.lit(0.0), lambda a, x: a + x)
    first = F.coalesce(fn.array_path(F.col("orders"), "o_orderkey", first=True), F.lit(-1))
    return j.select("left.c_custkey", F.size("orders").cast("long").alias("n"), F.round(total, 2).alias("total"), first.alias("first_order"))


@register(f"WITH {_ORDERS} SELECT c_custkey, count(*) AS n FROM c JOIN o ON c_custkey = o_custkey GROUP BY c_custkey")
def join_nested_inner(spark, d):
    return _customers_orders(spark, d, "inner").select("left.c_custkey", F.size("orders").cast("long").alias("n"))


@register("""
WITH o AS (SELECT * FROM orders WHERE o_totalprice > 150000), c AS (SELECT * FROM customer WHERE c_acctbal > 0)
SELECT c_custkey, count(*) AS n, min(o_orderkey) AS first_order FROM c JOIN o ON c_custkey = o_custkey GROUP BY c_custkey
UNION ALL SELECT NULL, 1, o_orderkey FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)""")
def join_nested_right(spark, d):
    """Customers with a positive balance, so that orders stay unmatched."""
    customers, orders = table(spark, d, "customer").filter("c_acctbal > 0"), table(spark, d, "orders").filter("o_totalprice > 150000")
    j = joins.nested(customers, orders, ("c_custkey", "o_custkey"), "right", "orders", "o_orderkey")
    return j.select("left.c_custkey", F.size("orders").cast("long").alias("n"), F.col("orders")[0]["o_orderkey"].alias("first_order"))


@register(f"WITH {_ORDERS} SELECT DISTINCT c_custkey FROM c JOIN o ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def join_where_any(spark, d):
    return joins.where_any(_customers_orders(spark, d, "left"), ["orders"], "o_orderstatus", "eq", "F").select("left.c_custkey")


def _join_query(spark, d, how="left"):
    return joins.JoinQuery(_customers_orders(spark, d, how))


@register(f"WITH {_ORDERS} SELECT DISTINCT c_custkey FROM c JOIN o ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000")
def join_query_where(spark, d):
    return _join_query(spark, d).where("c_mktsegment", "eq", "BUILDING").where("orders[].o_totalprice", "gt", 300000).select(c_custkey="c_custkey").df


@register(f"WITH {_ORDERS}, f AS (SELECT c_custkey, arg_min(o_orderstatus, o_orderkey) AS s FROM c JOIN o ON c_custkey = o_custkey GROUP BY c_custkey) SELECT c_custkey FROM f WHERE s = 'O'")
def join_query_where_first(spark, d):
    return _join_query(spark, d).where("orders.o_orderstatus", "eq", "O").select(c_custkey="c_custkey").df


@register(f"WITH {_ORDERS} SELECT c_custkey FROM c JOIN o ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(*) >= 3")
def join_query_where_fn(spark, d):
    return _join_query(spark, d).where_fn(lambda df: F.size(df["orders"]) >= 3).select(c_custkey="c_custkey").df


@register(f"WITH {_ORDERS} SELECT DISTINCT c_custkey FROM c JOIN o ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'")
def join_query_where_any(spark, d):
    return _join_query(spark, d).where_any("o_orderpriority", "eq", "1-URGENT").select(c_custkey="c_custkey").df


@register(f"""
WITH {_ORDERS}, f AS (SELECT c_custkey, any_value(c_acctbal) AS c_acctbal, arg_min(o_totalprice, o_orderkey) AS price FROM c LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT c_custkey, price FROM f ORDER BY price DESC NULLS FIRST, c_acctbal, c_custkey LIMIT 20 OFFSET 5""")
def join_query_order_limit(spark, d):
    j = _join_query(spark, d).order_by("c_custkey").order_by("c_acctbal").order_by("orders.o_totalprice", desc=True)
    return j.skip(5).limit(20).select(c_custkey="c_custkey", price="orders.o_totalprice").df


@register(f"""
WITH {_ORDERS} SELECT c_custkey AS id, any_value(c_name) AS name, min(o_orderkey) AS first_order,
  coalesce(string_agg(CAST(o_orderkey AS VARCHAR), '/' ORDER BY o_orderkey), '') AS keys
FROM c LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey""")
def join_query_select(spark, d):
    picked = _join_query(spark, d).select(id="c_custkey", name="left.c_name", first_order="orders.o_orderkey", keys="orders[].o_orderkey").df
    return picked.withColumn("keys", F.concat_ws("/", F.col("keys").cast("array<string>")))


def _join_aggregates() -> None:
    """A query for each aggregate over a field of all joined orders, as a whole and by segment."""
    for op in ("sum", "avg", "min", "max"):
        def one(spark, d, op=op):
            return _join_query(spark, d).aggregate("orders[].o_totalprice", op).select(F.round("value", 2).alias("value"))

        one.__name__ = f"join_aggregate_{op}"
        register(f"WITH {_ORDERS} SELECT round({op}(o_totalprice), 2) AS value FROM c JOIN o ON c_custkey = o_custkey")(one)

        def groups(spark, d, op=op):
            return _join_query(spark, d).group_by("c_mktsegment", "orders[].o_totalprice", op).select("key", F.round("value", 2).alias("value"))

        groups.__name__ = f"join_group_by_{op}"
        register(f"WITH {_ORDERS} SELECT c_mktsegment AS key, round(coalesce({op}(o_totalprice), 0), 2) AS value FROM c LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_mktsegment")(groups)


_join_aggregates()


@register(f"WITH {_ORDERS} SELECT count(*) AS value FROM c")
def join_aggregate_count(spark, d):
    return _join_query(spark, d).aggregate("orders[].o_totalprice", "count")


@register("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def join_flat_inner(spark, d):
    return joins.flat(table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 200000"), ("c_custkey", "o_custkey")).select("c_custkey", "o_orderkey")


@register("SELECT c_custkey, count(DISTINCT n_regionkey) AS regions, count(l_partkey) AS lines FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey WHERE p_size < 5 GROUP BY c_custkey")
def join_chain(spark, d):
    """The filter on part comes before the larger joins; regions of a customer are counted in two steps, without an expansion."""
    lines = joins.flat(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").filter("p_size < 5").select("p_partkey"), ("l_partkey", "p_partkey"))
    both = joins.chain(lines, (table(spark, d, "orders"), "l_orderkey", "o_orderkey", "inner"), (table(spark, d, "customer"), "o_custkey", "c_custkey", "inner"), (table(spark, d, "nation"), "c_nationkey", "n_nationkey", "inner"))
    by_region = both.groupBy("c_custkey", "n_regionkey").agg(F.count("l_partkey").alias("n"))
    return by_region.groupBy("c_custkey").agg(F.count("n_regionkey").alias("regions"), F.sum("n").alias("lines"))


@register(f"""
WITH {_ORDERS}, s AS (SELECT DISTINCT c_custkey, l_orderkey, l_suppkey FROM c JOIN o ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey)
SELECT c.c_custkey, count(DISTINCT l_suppkey) AS suppliers FROM c LEFT JOIN s USING (c_custkey) GROUP BY c.c_custkey""")
def join_nested_chain(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().withColumn("l_id", F.concat_ws("/", "l_orderkey", "l_suppkey"))
    j = joins.nested_chain(_customers_orders(spark, d, "left"), F.col("left.c_custkey"), "orders", "o_orderkey", lines, "l_orderkey", "l_id", "lines")
    return j.select("left.c_custkey", F.size(F.array_distinct(fn.array_path(F.col("lines"), "l_suppkey"))).cast("long").alias("suppliers"))


@register("SELECT c_custkey, n AS total_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) ON c_custkey = o_custkey")
def reactive_link(spark, d):
    orders = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    return joins.linked(table(spark, d, "customer"), orders, "c_custkey", "o_custkey", "total_orders", F.count("*")).select("c_custkey", "total_orders")


@register("SELECT c_custkey, CASE WHEN n > 0 THEN hi - lo END AS spread FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def reactive_link_callable(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    spread = lambda g: g["o_totalprice"].max() - g["o_totalprice"].min()
    return joins.linked(table(spark, d, "customer"), orders, "c_custkey", "o_custkey", "spread", spread).select("c_custkey", "spread")


# --- search --------------------------------------------------------------------------------------------------------


@register("SELECT doc_id FROM documents WHERE contains(lower(text), 'rights') ORDER BY doc_id LIMIT 50")
def text_search(spark, d):
    return search.text_search(table(spark, d, "documents"), "RIGHTS", "doc_id", 50, ["text"]).select("doc_id")


_BM25 = """
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[0-9]+') AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
f AS (SELECT doc_id, len(t) AS dl, w, len(list_filter(t, lambda x: x = w)) AS tf FROM t, (VALUES ('the'), ('rights'), ('reserved')) v(w)),
i AS (SELECT w, ln((any_value(n) - count(*) FILTER (tf > 0) + 0.5) / (count(*) FILTER (tf > 0) + 0.5) + 1.0) AS idf FROM f, s GROUP BY w),
b AS (SELECT doc_id, round(sum(idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM f JOIN i USING (w), s WHERE tf > 0 GROUP BY doc_id)"""


@register(f"WITH {_BM25} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    scored = search.bm25(table(spark, d, "documents"), "doc_id", "text", "The rights reserved").withColumn("score", F.round("score", 6))
    return search.top(scored, "doc_id", 10)


def _first_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


_COSINE = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS x FROM v WHERE vec_id = 0)"


@register(f"WITH {_COSINE} SELECT vec_id, round(list_cosine_similarity(e, x), 6) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 5")
def vector_topk(spark, d):
    return search.vector_search(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 5)


@register(f"WITH {_COSINE} SELECT vec_id, round(list_distance(e, x), 6) AS score FROM v, q ORDER BY score, vec_id LIMIT 5")
def euclidean_topk(spark, d):
    return search.vector_search(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 5, "euclidean")


@register("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_batch_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return search.vector_search_batch(vectors, "vec_id", "embedding", vectors.filter("vec_id % 100 = 0"), "vec_id", 5).select("query", "vec_id", "score", "rank")


@register()
def vector_ann(spark, d):
    """Approximate neighbours of every vector whose id is divisible by 100; tests hold them against vector_batch_topk."""
    vectors = table(spark, d, "embeddings")
    return search.VectorIndex.fit(vectors, "vec_id", "embedding").search(vectors.filter("vec_id % 100 = 0"), "vec_id", 5)


@register("SELECT CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE label <> 0")
def vector_index_changes(spark, d):
    """An index from which vectors were removed and to which some came back: all it holds, counted by cell."""
    vectors = table(spark, d, "embeddings")
    index = search.VectorIndex.fit(vectors, "vec_id", "embedding").remove(vectors.filter("label <= 1")).put(vectors.filter("label = 1"))
    return index.stats().agg(F.sum("n").alias("n"))


@register("SELECT count(*) AS n FROM conversations WHERE contains(lower(role), 'assist') OR contains(lower(text), 'assist')")
def record_search(spark, d):
    """Any field of the record, nested ones included, by its JSON text; names of fields count, too."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.struct("role", "text").alias("body"))
    found = search.record_search(rows, "ASSIST", "conv_id", None, ["body"])
    return found.agg(F.count("*").alias("n"))


_LIVE = _BM25.replace("FROM documents)", "FROM documents WHERE lang IS NOT DISTINCT FROM 'en' OR source IS NOT DISTINCT FROM 'src1')")


@register(f"WITH {_LIVE} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 10")
def text_index_topk(spark, d):
    """An index to which documents were added, some put again, and from which others were removed."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    live = F.col("lang").eqNullSafe("en") | F.col("source").eqNullSafe("src1")
    index = search.TextIndex(spark, f"{shared_dir(spark)}/docframe/index-{uuid.uuid4().hex}")
    index.put(docs.filter(F.coalesce(F.col("source") != "src1", F.lit(True))).withColumn("text", F.concat(F.lit("the the "), F.coalesce("text", F.lit("")))))
    index.put(docs.filter(live))
    index.remove(docs.filter(~live))
    return index.search("The rights reserved")


def _scores() -> None:
    """A query for each kind of condition."""
    kinds = {
        "eq": (("c_mktsegment", "eq", "BUILDING"), "CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END"),
        "between": (("c_acctbal", "between", (0, 8000)), "CASE WHEN c_acctbal BETWEEN 0 AND 8000 THEN 1 - 0.5 * abs(c_acctbal - 4000) / 4000 ELSE 0.0 END"),
        "near": (("c_nationkey", "near", 10), "1 / (1 + abs(c_nationkey - 10))"),
    }
    for name, (condition, sql) in kinds.items():
        def one(spark, d, condition=condition):
            return search.scored(table(spark, d, "customer"), [search.Condition(*condition)], 0.3).select("c_custkey", "score")

        one.__name__ = f"scored_{name}"
        register(f"SELECT * FROM (SELECT c_custkey, round(CAST({sql} AS DOUBLE), 4) AS score FROM customer) WHERE score >= 0.3")(one)


_scores()


@register("""
SELECT c_custkey, round(((CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) * 2 + (CASE WHEN c_acctbal BETWEEN 0 AND 8000 THEN 1 - 0.5 * abs(c_acctbal - 4000) / 4000 ELSE 0.0 END) + 1 / (1 + abs(c_nationkey - 10))) / 4, 4) AS score
FROM customer WHERE round(((CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) * 2 + (CASE WHEN c_acctbal BETWEEN 0 AND 8000 THEN 1 - 0.5 * abs(c_acctbal - 4000) / 4000 ELSE 0.0 END) + 1 / (1 + abs(c_nationkey - 10))) / 4, 4) >= 0.5""")
def scored_query(spark, d):
    c = search.Condition
    conditions = [c("c_mktsegment", "eq", "BUILDING", 2), c("c_acctbal", "between", (0, 8000)), c("c_nationkey", "near", 10)]
    return search.scored(table(spark, d, "customer"), conditions, 0.5).select("c_custkey", "score")


@register(f"""
WITH {_BM25}, {_COSINE},
x1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b ORDER BY score DESC, doc_id LIMIT 15),
y0 AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(e, x), 6) AS score FROM v, q),
y1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM y0 ORDER BY score DESC, doc_id LIMIT 15)
SELECT doc_id, round(sum(0.5 / (60 + r)), 6) AS score FROM (SELECT * FROM x1 UNION ALL SELECT * FROM y1) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5""")
def hybrid_rrf(spark, d):
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return search.hybrid(table(spark, d, "documents"), vectors, "doc_id", "text", "embedding", "The rights reserved", _first_vector(spark, d), 5)


# --- time series ---------------------------------------------------------------------------------------------------


def _series(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("metric"), "ts", "value", "event_id")


@register("SELECT event_id, value FROM events WHERE event_type = 'click' AND ts >= (SELECT max(ts) FROM events WHERE event_type = 'click') - INTERVAL 2 DAY")
def ts_range(spark, d):
    return temporal.ts_range(_series(spark, d), "click", last="2d").select("event_id", "value")


@register("SELECT event_type AS metric, round(sum(value), 4) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(value) AS count FROM events GROUP BY event_type")
def ts_aggregate(spark, d):
    return temporal.ts_aggregate(_series(spark, d)).withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@register("SELECT event_type AS metric, time_bucket(INTERVAL '1 hour', ts) AS bucket, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def ts_downsample_avg(spark, d):
    return temporal.downsample(_series(spark, d), "1h", "avg").withColumn("value", F.round("value", 6))


@register("SELECT event_type AS metric, time_bucket(INTERVAL '15 minutes', ts) AS bucket, CAST(count(value) AS DOUBLE) AS value FROM events GROUP BY ALL")
def ts_downsample_count(spark, d):
    return temporal.downsample(_series(spark, d), "15m", "count")


@register("SELECT event_type AS metric, time_bucket(INTERVAL '1 day', ts) AS bucket, max(value) AS value FROM events GROUP BY ALL")
def ts_downsample_max(spark, d):
    return temporal.downsample(_series(spark, d), "1d", "max")


@register("SELECT event_type AS metric, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY event_type")
def ts_latest(spark, d):
    return temporal.ts_latest(_series(spark, d))


@register("SELECT event_type AS metric, round((arg_max(value, ts) - arg_min(value, ts)) / (epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6) * 1e6, 6) AS rate FROM events GROUP BY event_type")
def ts_rate(spark, d):
    return temporal.rate(_series(spark, d)).select("metric", F.round(F.col("rate") * 1e6, 6).alias("rate"))


@register("SELECT event_type AS metric, count(*) AS points, min(ts) AS since, max(ts) AS upto FROM events GROUP BY event_type")
def ts_metrics(spark, d):
    return temporal.ts_metrics(_series(spark, d))


@register("SELECT count(DISTINCT event_type) AS series, count(*) AS points FROM events")
def ts_totals(spark, d):
    return temporal.ts_totals(_series(spark, d))


@register("SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 30")
def ts_tail(spark, d):
    """The newest points of a metric."""
    newest = temporal.ts_range(_series(spark, d), "click", limit=30)
    return newest.select("event_id", "value")


@register("SELECT event_type AS metric, time_bucket(INTERVAL '1 hour', ts) AS bucket, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def ts_downsample_sum(spark, d):
    return temporal.downsample(_series(spark, d), "1h", "sum").withColumn("value", F.round("value", 4))


@register("SELECT event_type AS metric, time_bucket(INTERVAL '1 day', ts) AS bucket, min(value) AS value FROM events GROUP BY ALL")
def ts_downsample_min(spark, d):
    return temporal.downsample(_series(spark, d), "1d", "min")


@register("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def ts_retention(spark, d):
    return temporal.retained(_series(spark, d), datetime(2024, 1, 20)).select("event_id")


# --- versions and changes ------------------------------------------------------------------------------------------


def _log(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.row_number().over(w).alias("version"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("deleted"), "event_type", "value")


_LOG = "l AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, ts AS \"at\", event_type = 'error' AS deleted, event_type, value FROM events)"


@register(f"WITH {_LOG} SELECT id, CAST(version AS INTEGER) AS version, \"at\", deleted, value FROM l WHERE id = 7")
def history(spark, d):
    return temporal.history(_log(spark, d), 7).select("id", "version", "at", "deleted", "value")


@register(f"WITH {_LOG} SELECT id, CAST(version AS INTEGER) AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY \"at\" DESC, version DESC) AS k FROM l WHERE \"at\" <= TIMESTAMP '2024-01-15') WHERE k = 1 AND NOT deleted")
def as_of_snapshot(spark, d):
    return temporal.snapshot(_log(spark, d), datetime(2024, 1, 15)).select("id", "version", "value")


@register(f"WITH {_LOG} SELECT id, CAST(version AS INTEGER) AS version, value FROM l WHERE id = 7 AND NOT deleted AND version = (SELECT max(version) FROM l WHERE id = 7 AND \"at\" <= TIMESTAMP '2024-01-15')")
def record_as_of(spark, d):
    return temporal.record_at(_log(spark, d), 7, datetime(2024, 1, 15)).select("id", "version", "value")


@register(f"WITH {_LOG} SELECT a.id, 'event_type' AS field, a.event_type AS a, b.event_type AS b FROM l a JOIN l b ON a.id = b.id AND a.version = 1 AND b.version = 2 WHERE a.event_type IS DISTINCT FROM b.event_type")
def version_diff(spark, d):
    return temporal.diff(_log(spark, d), 1, 2, ["event_type"])


@register(f"WITH {_LOG} SELECT id, CAST(version AS INTEGER) AS version FROM l WHERE \"at\" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def changes_between(spark, d):
    return temporal.changes_between(_log(spark, d), datetime(2024, 1, 10), datetime(2024, 1, 12)).select("id", "version")


@register(f"WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY \"at\" DESC, version DESC) AS k, count(*) OVER (PARTITION BY id) AS n FROM l) SELECT id, CAST(version AS INTEGER) AS version FROM n WHERE n <= 2 OR k = 1 OR \"at\" >= TIMESTAMP '2024-01-25'")
def mvcc_gc(spark, d):
    return temporal.collected(_log(spark, d), datetime(2024, 1, 25)).select("id", "version")


@register(f"WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY \"at\", version) AS k, count(*) OVER (PARTITION BY id) AS n FROM l) SELECT id, CAST(version AS INTEGER) AS version FROM n WHERE n <= 20 OR k = 1 OR k > n - 10")
def version_compaction(spark, d):
    return temporal.compacted(_log(spark, d), 20, 10).select("id", "version")


@register(f"WITH {_LOG}, e AS (SELECT CASE WHEN deleted THEN 'delete' WHEN lag(deleted) OVER (PARTITION BY id ORDER BY \"at\", version) IS NOT DISTINCT FROM false THEN 'update' ELSE 'insert' END AS op FROM l) SELECT op, count(*) AS n FROM e GROUP BY op")
def cdc_counts(spark, d):
    return temporal.events_of(_log(spark, d), ["event_type"]).groupBy("op").agg(F.count("*").alias("n"))


@register(f"WITH {_LOG} SELECT id, CAST(version AS INTEGER) AS version, lag(value) OVER (PARTITION BY id ORDER BY \"at\", version) AS old_value FROM l")
def cdc_old_value(spark, d):
    return temporal.events_of(_log(spark, d), ["value"]).select("id", "version", F.col("old_data.value").alias("old_value"))


@register(f"WITH {_LOG} SELECT id, CAST(version AS INTEGER) AS version FROM l WHERE \"at\" >= TIMESTAMP '2024-01-28'")
def cdc_since(spark, d):
    return temporal.since(_log(spark, d), datetime(2024, 1, 28)).select("id", "version")


@register(f"WITH {_LOG}, e AS (SELECT *, CASE WHEN deleted THEN 'delete' WHEN lag(deleted) OVER (PARTITION BY id ORDER BY \"at\", version) IS NOT DISTINCT FROM false THEN 'update' ELSE 'insert' END AS op FROM l) SELECT id, CAST(version AS INTEGER) AS version FROM e WHERE op = 'update' AND id < 50 AND event_type = 'click'")
def cdc_filter(spark, d):
    """Changes of one kind to some records."""
    events = temporal.events_of(_log(spark, d), ["event_type"])
    return temporal.filtered(events, "update", (F.col("id") < 50) & (F.col("data.event_type") == "click")).select("id", "version")


@register("SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25)")
def cdc_recent(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct("ts", "event_id").alias("at"))
    return temporal.recent(rows, 25).select("event_id")


_KEPT = "CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END"


def _logged(spark, d) -> LoggedCollection:
    """Customers inserted in one write, some updated, some deleted, one restored: each a write of its own."""
    c = LoggedCollection(spark, f"{shared_dir(spark)}/docframe/log-{uuid.uuid4().hex}", "c_custkey long, c_acctbal double, c_nationkey int")
    c.insert_df(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_custkey", "c_acctbal", "c_nationkey"), at=1.0, tx_id="t1")
    c.update_many(F.col("c_nationkey") == 3, {"c_acctbal": F.col("c_acctbal") + 100}, at=2.0, tx_id="t2")
    c.delete_many(F.col("c_acctbal") < 0, at=3.0, tx_id="t3")
    return c


@register(f"SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS version, round({_KEPT}, 2) AS c_acctbal FROM customer WHERE {_KEPT} >= 0")
def logged_writes(spark, d):
    return _logged(spark, d).current().select("id", "version", F.round("c_acctbal", 2).alias("c_acctbal"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS version FROM customer")
def logged_as_of(spark, d):
    return _logged(spark, d).as_of(2.5).select("id", "version")


@register(f"""
SELECT 't1' AS tx_id, count(*) AS n FROM customer UNION ALL SELECT 't2', count(*) FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 't3', count(*) FROM customer WHERE {_KEPT} < 0""")
def logged_transactions(spark, d):
    """What each transaction wrote; one that wrote nothing counts 0."""
    c = _logged(spark, d)
    names = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "tx string")
    return names.join(c.log, F.col("tx") == F.col("tx_id"), "left").groupBy(F.col("tx").alias("tx_id")).agg(F.count("id").alias("n"))


@register("SELECT c_custkey AS key, c_name AS name, CASE WHEN c_nationkey = 3 THEN 'x where y' ELSE c_mktsegment END AS segment FROM customer WHERE c_acctbal >= 0")
def sql_writes(spark, d):
    """INSERT, UPDATE and DELETE, with a keyword inside a literal."""
    db = Database(spark)
    db.execute("CREATE TABLE held_customers (key BIGINT, name STRING, segment STRING, nation INT, balance DOUBLE)")
    table(spark, d, "customer").createOrReplaceTempView("customer")
    db.execute("INSERT INTO held_customers (key, name, segment, nation, balance) SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal FROM customer")
    db.execute("UPDATE held_customers SET segment = 'x where y' WHERE nation = 3")
    db.execute("DELETE FROM held_customers WHERE balance < 0")
    return db.execute("SELECT key, name, segment FROM held_customers")


# --- files ---------------------------------------------------------------------------------------------------------


@register("SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def csv_round_trip(spark, d):
    """Out to CSV and in again; nulls are blank cells."""
    at = f"{shared_dir(spark)}/docframe/csv-{uuid.uuid4().hex}"
    sources.export_csv(table(spark, d, "supplier").withColumn("s_acctbal", F.when(F.col("s_nationkey") != 3, F.col("s_acctbal"))), at, ["s_suppkey", "s_name", "s_acctbal"])
    return sources.import_csv(spark, at, {"s_suppkey": "long", "s_acctbal": "double"})


@register("SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def json_round_trip(spark, d):
    """Out to JSON lines and in again, nulls written."""
    at = f"{shared_dir(spark)}/docframe/json-{uuid.uuid4().hex}"
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") != 3, F.col("s_acctbal")).alias("s_acctbal"))
    sources.export_json(rows, at)
    return spark.read.schema(rows.schema).json(at)


@register("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def backup_restore(spark, d):
    at = f"{shared_dir(spark)}/docframe/backup-{uuid.uuid4().hex}"
    sources.backup(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), at)
    return sources.restore(spark, at)


# --- streams -------------------------------------------------------------------------------------------------------


def _event_stream(spark, d):
    return streaming.change_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)


@register("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, d):
    return streaming.drained(streaming.counts(_event_stream(spark, d), "event_type"), f"counts_{uuid.uuid4().hex}")


@register("SELECT event_type AS metric, time_bucket(INTERVAL '1 hour', ts) AS bucket, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY ALL")
def stream_downsample(spark, d):
    out = streaming.drained(streaming.downsample(_event_stream(spark, d), "ts", "event_type", "value", "1h"), f"hours_{uuid.uuid4().hex}")
    return out.withColumn("value", F.round("value", 6))


# --- lineage, shards, validation -----------------------------------------------------------------------------------


def _nodes(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    c = c.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.array(F.concat_ws("/", F.col("conv_id"), F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"), F.when(F.col("role") == "user", "merge").otherwise("update").alias("op"))
    return c


_DAG = """
WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN min(role) = 'user' THEN 'merge' ELSE 'update' END AS op FROM conversations GROUP BY conv_id, turn),
a AS (SELECT conv_id || '/' || turn AS root, conv_id, turn, 0 AS depth FROM n
      UNION ALL SELECT a.root, n.conv_id, n.turn, a.depth + 1 FROM a JOIN n ON n.conv_id = a.conv_id AND n.turn = a.turn - 1)"""


@register(_DAG + " SELECT root, conv_id || '/' || turn AS id, depth FROM a")
def dag_ancestors(spark, d):
    """From every node."""
    nodes = _nodes(spark, d)
    return graph.ancestors(nodes, nodes.select("id"))


_TIPS = "t AS (SELECT conv_id || '/' || turn AS tip FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.conv_id = x.conv_id AND y.turn = x.turn + 1))"


@register(f"""
{_DAG}, {_TIPS}
SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY depth DESC, a.conv_id || '/' || a.turn) AS INTEGER) AS step, a.conv_id || '/' || a.turn AS id, op
FROM a JOIN t ON root = tip JOIN n ON n.conv_id = a.conv_id AND n.turn = a.turn WHERE op <> 'merge'""")
def dag_replay(spark, d):
    """The writes that lead to each tip, oldest first, merges left out."""
    nodes = _nodes(spark, d)
    return graph.replay(nodes, graph.ancestors(nodes, graph.tips(nodes).select("id")))


@register(f"{_DAG}, {_TIPS} SELECT tip AS id FROM t")
def dag_tips(spark, d):
    return graph.tips(_nodes(spark, d)).select("id")


@register("""
WITH n AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn)
SELECT count(*) AS nodes, count(*) FILTER (role = 'user') AS merges, count(*) FILTER (turn = 0) AS roots, count(*) FILTER (turn > 0) AS edges FROM n""")
def dag_stats(spark, d):
    return graph.stats(_nodes(spark, d))


@register("""
WITH t AS (SELECT conv_id, conv_id || '/' || max(turn) AS id, conv_id // 5 AS part FROM conversations GROUP BY conv_id)
SELECT part, string_agg(id, ',' ORDER BY id) AS parents FROM t GROUP BY part HAVING count(*) > 1""")
def dag_merge(spark, d):
    """A merge of the tips of each five conversations."""
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    branches = last.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.floor(F.col("conv_id") / 5).alias("part"))
    return graph.merges(branches, "part").withColumn("parents", F.concat_ws(",", "parents"))


@register("SELECT c_custkey, CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS UBIGINT) % 16 AS INTEGER) AS shard FROM customer")
def shard_route(spark, d):
    return shards.routed(table(spark, d, "customer"), "c_custkey", 16).select("c_custkey", "shard")


@register("SELECT CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS UBIGINT) % 16 AS INTEGER) AS shard, count(*) AS n FROM customer GROUP BY 1")
def shard_counts(spark, d):
    return shards.counts(table(spark, d, "customer"), "c_custkey", 16)


@register("SELECT c_custkey, CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS UBIGINT) % 6 AS INTEGER) AS shard FROM customer")
def shard_rebalance(spark, d):
    """Written for 4 shards, then for 6: rows stay, shards change."""
    at = f"{shared_dir(spark)}/docframe/shards-{uuid.uuid4().hex}"
    shards.write(table(spark, d, "customer").select("c_custkey"), "c_custkey", 4, f"{at}/4")
    shards.rebalance(spark.read.parquet(f"{at}/4"), "c_custkey", 6, f"{at}/6")
    return spark.read.parquet(f"{at}/6").select("c_custkey", "shard")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def shard_get(spark, d):
    """One key, from its shard's folder."""
    at = f"{shared_dir(spark)}/docframe/shards-{uuid.uuid4().hex}"
    shards.write(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 8, at)
    return shards.get(spark, at, "c_custkey", 77, 8).select("c_custkey", "c_name")


@register("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT n_nationkey FROM nation")
def shard_gather(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"))]
    return shards.gathered(parts)


@register("SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS INTEGER) AS n, c_acctbal > 0 AS positive, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def validate_coercion(spark, d):
    """Text to numbers and booleans, numbers to text."""
    rows = table(spark, d, "customer").select("c_custkey", F.substring("c_name", 10, 20).alias("n"), F.when(F.col("c_acctbal") > 0, "YES").otherwise("no").alias("positive"), F.col("c_nationkey").alias("nation"))
    f = validate.Field
    return validate.validated(rows, {"n": f(type="int"), "positive": f(type="boolean"), "nation": f(type="string")}).drop("_errors")


@register("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN length(p_name) < 12 THEN 'p_name: shorter than 12' END, CASE WHEN length(p_name) > 16 THEN 'p_name: longer than 16' END,
  CASE WHEN p_size > 40 THEN 'p_size: more than 40' END], lambda x: x IS NOT NULL), ';') AS errors FROM part""")
def validate_lengths(spark, d):
    f = validate.Field
    checked = validate.validated(table(spark, d, "part"), {"p_name": f(min_length=12, max_length=16), "p_size": f(max=40)})
    return checked.select("p_partkey", F.concat_ws(";", "_errors").alias("errors"))


@register("SELECT n_nationkey, coalesce(n, 'none') AS n, CASE WHEN n_nationkey >= 20 THEN 'n_nationkey: validator;n_regionkey: unknown' ELSE 'n_regionkey: unknown' END AS errors FROM (SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_name END AS n FROM nation)")
def validate_strict(spark, d):
    """Defaults, a validator over Arrow batches, and columns that the schema doesn't have."""
    rows = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("n"), "n_regionkey")
    f = validate.Field
    checked = validate.validated(rows, {"n_nationkey": f(validator=lambda s: s < 20, batches=True), "n": f(default="none")}, strict=True)
    return checked.select("n_nationkey", "n", F.concat_ws(";", "_errors").alias("errors"))


@register("""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'c_acctbal: less than 0' END, CASE WHEN NOT regexp_matches(c_name, '^(?:Customer#0000.*[13579]$)') THEN 'c_name: pattern' END,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment: choices' END], lambda x: x IS NOT NULL), ';') AS errors FROM customer""")
def schema_validate(spark, d):
    f = validate.Field
    schema = {"c_acctbal": f(type="double", min=0), "c_name": f(required=True, pattern="Customer#0000.*[13579]$"), "c_mktsegment": f(choices=("BUILDING", "MACHINERY"))}
    return validate.validated(table(spark, d, "customer"), schema).select("c_custkey", F.concat_ws(";", "_errors").alias("errors"))
