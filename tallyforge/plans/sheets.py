"""Queries of the sheet operations and the formula language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formula import add_calculated_column
from ..operators import sheet
from .base import query

KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"
KEYS = KEY.split(", ")


@query("flagship", """
SELECT l_returnflag, count(*) AS invoices, CAST(sum(CAST(total AS DECIMAL(18,4))) AS DOUBLE) AS total
FROM (SELECT l_returnflag, round(l_extendedprice + l_extendedprice * l_tax, 4) AS total FROM lineitem WHERE l_extendedprice > 20000) GROUP BY 1""")
def flagship(t):
    big = sheet.filter_rows(t.lineitem, (">", "l_extendedprice", 20000.0))
    taxed = add_calculated_column(big, "total", "ROUND([l_extendedprice] + [l_extendedprice] * [l_tax], 4)")
    out = taxed.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("invoices"), F.sum(F.col("total").cast("decimal(18,4)")).cast("double").alias("total"))
    return sheet.sort(out, [("l_returnflag", False)])


@query("op_select_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    return sheet.select_columns(t.orders, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("op_rename_columns", "SELECT c_custkey AS customer, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    return sheet.rename_columns(t.customer.select("c_custkey", "c_name", "c_mktsegment"), {"c_custkey": "customer", "c_name": "name", "c_mktsegment": "segment"})


@query("op_add_calculated_column", f"SELECT {KEY}, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(t):
    return add_calculated_column(t.lineitem.select(*KEYS, "l_discount"), "net", "[l_extendedprice] * (1 - [l_discount])").drop("l_discount")


def _filter(name, spec, where):
    @query(f"op_filter_{name}", f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS prio FROM orders) WHERE {where}")
    def _(t, spec=spec):
        rows = t.orders.withColumn("prio", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
        return sheet.filter_rows(rows, spec).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


_filter("cmp", (">=", "o_totalprice", 100000.0), "o_totalprice >= 100000")
_filter("in", ("in", "o_orderstatus", ["O", "P"]), "o_orderstatus IN ('O', 'P')")
_filter("contains", ("contains", "o_orderpriority", "IG"), "contains(o_orderpriority, 'IG')")
_filter("date_range", ("between", "o_orderdate", ("1995-01-01", "1996-12-31")), "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
_filter("null", ("is_null", "prio"), "prio IS NULL")
_filter("and_or", ("and", [("or", [("=", "o_orderstatus", "F"), ("<", "o_totalprice", 50000.0)]), ("not", ("in", "o_orderpriority", ["1-URGENT"])), ("not_null", "prio")]),
        "(o_orderstatus = 'F' OR o_totalprice < 50000) AND NOT o_orderpriority IN ('1-URGENT') AND prio IS NOT NULL")


@query("op_fill_value", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
def _(t):
    return sheet.fill_value(t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")), {"segment": "none"})


@query("op_fill_forward", """
SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)""")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return sheet.fill_forward(rows, ["v"], ["ts", "event_id"], ["user_id"]).drop("ts")


@query("op_cast_type", "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE event_id::VARCHAR END AS BIGINT) AS n FROM events")
def _(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("n"))
    return sheet.cast_type(rows, {"n": "bigint"})


@query("op_split_column", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank, CASE WHEN contains(o_orderpriority, '-') THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) END AS label FROM orders")
def _(t):
    return sheet.split_column(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", ["rank", "label"]).drop("o_orderpriority")


@query("op_merge_columns", "SELECT c_custkey, concat_ws(' / ', c_name, nullif(c_mktsegment, 'BUILDING')) AS label FROM customer")
def _(t):
    rows = t.customer.select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return sheet.merge_columns(rows, ["c_name", "segment"], " / ", "label").select("c_custkey", "label")


def _group(name, function, column, sql):
    @query(f"op_group_{name}", f"SELECT c_nationkey, {sql} AS v FROM customer GROUP BY 1")
    def _(t):
        out = sheet.group_aggregate(t.customer.withColumn("money", sheet.money("c_acctbal")), ["c_nationkey"], {"v": (function, column)})
        return out.withColumn("v", F.col("v").cast("double")) if column == "money" else out


_group("sum", "sum", "money", "CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE)")
_group("min", "min", "c_acctbal", "min(c_acctbal)")
_group("max", "max", "c_acctbal", "max(c_acctbal)")
_group("count", "count", "c_custkey", "count(c_custkey)")
_group("count_distinct", "count_distinct", "c_mktsegment", "count(DISTINCT c_mktsegment)")


@query("op_group_mean", "SELECT c_nationkey, round(sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE / count(c_acctbal), 4) AS v FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_nationkey").agg(F.round(F.sum(sheet.money("c_acctbal")).cast("double") / F.count("c_acctbal"), 4).alias("v"))


@query("op_group_median", "SELECT c_nationkey, round(median(c_acctbal), 4) AS v FROM customer GROUP BY 1")
def _(t):
    return sheet.group_aggregate(t.customer, ["c_nationkey"], {"v": ("median", "c_acctbal")}).withColumn("v", F.round("v", 4))


@query("op_group_two_keys", "SELECT o_orderstatus, o_orderpriority, count(*) AS invoices FROM orders GROUP BY 1, 2")
def _(t):
    return sheet.sort(t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("invoices")), [("o_orderstatus", False), ("o_orderpriority", False)])


@query("total_count", "SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def _(t):
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.sum(sheet.money("o_totalprice")).cast("double").alias("total"))


STATUSES = ["F", "O", "P"]


@query("op_pivot", "SELECT o_orderpriority, " + ", ".join(f"coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = '{s}') AS DOUBLE), 0) AS {s}" for s in STATUSES) + " FROM orders GROUP BY 1")
def _(t):
    return sheet.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", STATUSES, F.sum(sheet.money("o_totalprice")).cast("double"))


@query("op_unpivot", "SELECT s_suppkey, unnest(['s_nationkey', 's_acctbal']) AS metric, unnest([s_nationkey::DOUBLE, s_acctbal]) AS amount FROM supplier")
def _(t):
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal")
    return sheet.unpivot(rows, ["s_suppkey"], ["s_nationkey", "s_acctbal"], "metric", "amount")


@query("op_join_inner", "SELECT c_custkey, o_orderkey, c_mktsegment, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def _(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return sheet.join(t.customer.select("c_custkey", "c_mktsegment"), orders, ["c_custkey"])


@query("op_join_left", "SELECT c_custkey, o_orderkey, c_mktsegment FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey")
def _(t):
    orders = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return sheet.join(t.customer.select("c_custkey", "c_mktsegment"), orders, ["c_custkey"], "left")


@query("op_sort", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def _(t):
    return sheet.sort(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), [("c_mktsegment", False), ("c_acctbal", True), ("c_custkey", False)])


@query("op_top_n", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return sheet.top_n(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 10, "o_totalprice", ["o_orderkey"])


@query("top_customers", "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10")
def _(t):
    return sheet.top_n(t.orders.groupBy("o_custkey").agg(F.sum(sheet.money("o_totalprice")).cast("double").alias("total")), 10, "total", ["o_custkey"])


@query("preview", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000) ORDER BY o_orderkey LIMIT 20")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(1000).orderBy("o_orderkey").limit(20)


@query("op_append", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _(t):
    return sheet.append(t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"), t.supplier.selectExpr("s_suppkey AS id", "s_name AS name"))


@query("op_deduplicate", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(t):
    return sheet.deduplicate(t.customer.select("c_mktsegment", "c_nationkey"))


@query("op_dedup_keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(t):
    return sheet.deduplicate(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("profile_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{k}' AS type, count(*) AS rows, count(*) - count({e}) AS blanks, count(DISTINCT {e}) AS distinct_values, 0 AS duplicate_rows FROM customer"
    for c, k, e in (("c_custkey", "bigint", "c_custkey"), ("segment", "string", "nullif(c_mktsegment, 'BUILDING')"), ("c_nationkey", "int", "c_nationkey"))))
def _(t):
    return sheet.profile(t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_nationkey"))


@query("share_of_total", "SELECT o_orderstatus, round(100.0 * sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)::DOUBLE, 4) AS share FROM orders GROUP BY 1")
def _(t):
    from pyspark.sql.window import Window

    sums = t.orders.groupBy("o_orderstatus").agg(F.sum(sheet.money("o_totalprice")).cast("double").alias("s"))
    return sums.select("o_orderstatus", F.round(100.0 * F.col("s") / F.sum("s").over(Window.partitionBy()), 4).alias("share"))  # one row per status


def _formula(name, text, sql, table="lineitem"):
    keys = KEYS if table == "lineitem" else ["o_orderkey"]

    @query(f"expr_{name}", f"SELECT {', '.join(keys)}, {sql} AS v FROM {table}")
    def _(t):
        return add_calculated_column(getattr(t, table), "v", text).select(*keys, "v")


_formula("arith", "-[l_quantity] + [l_extendedprice] * 2 - [l_linenumber]", "-l_quantity + l_extendedprice * 2 - l_linenumber")
_formula("div_null", "[l_extendedprice] / ([l_linenumber] - 3)", "l_extendedprice / nullif(l_linenumber - 3, 0)")
_formula("compare", "[l_quantity] >= 25", "l_quantity >= 25")
_formula("logic3", 'NOT ([l_extendedprice] / ([l_linenumber] - 1) > 1000) OR [l_returnflag] = "R"', "NOT (l_extendedprice / nullif(l_linenumber - 1, 0) > 1000) OR l_returnflag = 'R'")
_formula("if", 'IF([l_discount] / ([l_linenumber] - 2) >= 0.02, "high", "low")', "CASE WHEN l_discount / nullif(l_linenumber - 2, 0) IS NULL THEN NULL WHEN l_discount / nullif(l_linenumber - 2, 0) >= 0.02 THEN 'high' ELSE 'low' END")
_formula("round", "ROUND([l_linenumber] * 0.3, 0) + ROUND([l_linenumber])", "round(l_linenumber * 0.3, 0) + l_linenumber")
_formula("abs", "ABS([l_linenumber] - 4)", "abs(l_linenumber::BIGINT - 4)")
_formula("minmax", "MAX([l_quantity], [l_linenumber] * 10, 20) - MIN([l_quantity] / ([l_linenumber] - 1), 30)", "greatest(l_quantity, l_linenumber * 10, 20) - least(l_quantity / nullif(l_linenumber - 1, 0), 30)")
_formula("mixed", 'IF([o_orderstatus] = "F" AND [o_totalprice] > 1e5, ROUND([o_totalprice] / 1000, 0), -1)', "CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1e5 THEN round(o_totalprice / 1000, 0) ELSE -1 END", "orders")
