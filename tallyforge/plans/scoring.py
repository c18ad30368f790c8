"""Queries of scoring and load analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, sheet
from .base import query

STATUS_SQL = "CASE WHEN event_id % 10 = 0 THEN 'skipped' WHEN value >= 40 THEN 'passed' ELSE 'failed' END"


def _results(t):
    status = F.when(F.col("event_id") % 10 == 0, "skipped").when(F.col("value") >= 40, "passed").otherwise("failed")
    return t.events.select("event_id", "event_type", "user_id", "value", "ts", status.alias("status"))


@query("category_stats", f"""
SELECT event_type, count(*) AS cases, count(*) FILTER (s = 'passed') AS passed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped,
       round(count(*) FILTER (s = 'passed') / nullif(count(*) FILTER (s <> 'skipped'), 0), 4) AS pass_rate
FROM (SELECT *, {STATUS_SQL} AS s FROM events) GROUP BY 1""")
def _(t):
    return scoring.category_stats(_results(t), "event_type", "status")


@query("gates", """
WITH m AS (SELECT round(avg(quality), 6) AS quality, sum(toxic)::DOUBLE AS toxic, NULL::DOUBLE AS judged FROM labels)
SELECT 'quality' AS gate, quality AS value, CASE WHEN quality >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict FROM m
UNION ALL SELECT 'toxic', toxic, CASE WHEN toxic <= 10 THEN 'pass' ELSE 'fail' END FROM m UNION ALL SELECT 'judged', judged, 'n/a' FROM m""")
def _(t):
    m = t.labels.agg(F.round(F.avg("quality"), 6).alias("quality"), F.sum("toxic").alias("toxic"), F.lit(None).cast("double").alias("judged"))
    return scoring.gates(m, {"quality": ("min", 0.5), "toxic": ("max", 10), "judged": ("min", 4)})


@query("failure_hist", f"SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT *, {STATUS_SQL} AS s FROM events) WHERE s = 'failed' GROUP BY 1")
def _(t):
    failed = _results(t).where("status = 'failed'")
    return failed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"))


@query("percentile_latency", "SELECT event_type, round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def _(t):
    return scoring.percentiles(t.events, ["event_type"], "value", (0.05, 0.5, 0.95))


@query("soak_summary", "SELECT event_type, max(value) AS peak, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, round(min(value) / max(value), 6) AS low_ratio, max(event_id) - min(event_id) AS delta FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(
        F.max("value").alias("peak"), F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"),
        F.round(F.try_divide(F.min("value"), F.max("value")), 6).alias("low_ratio"), (F.max("event_id") - F.min("event_id")).alias("delta"),
    )


@query("rate_per_minute", "SELECT event_type, round(count(*) * 60.0 / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 6) AS rate FROM events GROUP BY 1")
def _(t):
    seconds = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    return t.events.where("ts IS NOT NULL").groupBy("event_type").agg(F.round(scoring.per_minute(F.count(F.lit(1)), seconds), 6).alias("rate"))


@query("table_compare", """
WITH e AS (SELECT c_mktsegment AS k, c_nationkey AS g, round(avg(c_acctbal), 2) AS v FROM customer GROUP BY 1, 2),
a AS (SELECT k, g, CASE WHEN g = 7 THEN v + 1 ELSE v END AS v FROM e WHERE g <> 11)
SELECT k, g, CASE WHEN a.v IS NULL THEN 'missing' ELSE 'different' END AS problem FROM e LEFT JOIN a USING (k, g) WHERE a.v IS NULL OR abs(a.v - e.v) > 0.005""")
def _(t):
    e = t.customer.groupBy(F.col("c_mktsegment").alias("k"), F.col("c_nationkey").alias("g")).agg(F.round(F.avg("c_acctbal"), 2).alias("v"))
    a = e.where("g <> 11").withColumn("v", F.when(F.col("g") == 7, F.col("v") + 1).otherwise(F.col("v")))
    return scoring.table_compare(e, a, ["k", "g"], {"v": 2})


@query("judge_mean", "SELECT quality, round(avg((quality * 5 + toxic) / 2.0), 6) AS score, count(*) AS n FROM labels GROUP BY 1")
def _(t):
    return t.labels.groupBy("quality").agg(F.round(F.avg((F.col("quality") * 5 + F.col("toxic")) / 2.0), 6).alias("score"), F.count(F.lit(1)).alias("n"))


@query("corpus_composition", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def _(t):
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("backoff", "SELECT l_linenumber AS attempt, least(60.0, 2.0 * pow(2.0, l_linenumber - 1)) AS delay FROM lineitem GROUP BY 1")
def _(t):
    from ..functions.text import backoff

    return t.lineitem.select(F.col("l_linenumber").alias("attempt")).distinct().withColumn("delay", backoff(F.col("attempt"), 2.0, 60.0))


@query("fiscal_pivot", "SELECT o_orderstatus, " + ", ".join(f"coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER ((month(o_orderdate) + 8) % 12 = {m}) AS DOUBLE), 0) AS \"{m}\"" for m in range(12)) + " FROM orders GROUP BY 1")
def _(t):
    from ..functions.text import fiscal_month

    rows = t.orders.withColumn("m", fiscal_month(F.col("o_orderdate")))
    return sheet.pivot(rows, ["o_orderstatus"], "m", range(12), F.sum(sheet.money("o_totalprice")).cast("double"))
