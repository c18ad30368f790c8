"""Queries over records, lines and small text rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import relational
from ..sources import sinks
from .base import query


@query("map_allow_list", "SELECT event_id, array_to_string(list_sort([x.k || '=' || x.v FOR x IN [{'k': 'type', 'v': event_type}, {'k': 'value_count', 'v': user_id::VARCHAR}, {'k': 'secret', 'v': 'x'}] IF x.k IN ('type') OR ends_with(x.k, '_count')]), ',') AS kept FROM events")
def _(t):
    fields = F.create_map(F.lit("type"), F.col("event_type"), F.lit("value_count"), F.col("user_id").cast("string"), F.lit("secret"), F.lit("x"))
    kept = F.map_filter(fields, lambda k, v: k.isin("type") | k.endswith("_count"))
    return t.events.select("event_id", F.array_join(F.sort_array(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("kept"))


@query("case_selection", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 3) AND regexp_matches(p_partkey::VARCHAR, '^1.*[05]$')")
def _(t):
    few = t.part.select("p_brand").distinct().orderBy("p_brand").limit(3)
    return t.part.where(F.col("p_partkey").cast("string").rlike("^1.*[05]$")).join(F.broadcast(few), "p_brand", "left_semi").select("p_partkey")  # three rows


@query("safe_filename", "SELECT p_partkey, substr(trim(regexp_replace('../' || p_name || '?' || p_type || chr(9) || '.csv', '[\\x00-\\x1f\\x7f/\\\\:*?\"<>|]', '', 'g')), 1, 120) AS name FROM part")
def _(t):
    return t.part.select("p_partkey", tx.safe_filename(F.concat(F.lit("../"), "p_name", F.lit("?"), "p_type", F.lit("\t.csv"))).alias("name"))


@query("numbers_pool", "SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS number FROM documents")
def _(t):
    return t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("number")).distinct()


@query("version_children", "SELECT p.o_orderkey AS parent, c.o_orderkey AS child FROM orders p JOIN orders c ON c.o_orderkey // 4 = p.o_orderkey AND c.o_orderkey <> p.o_orderkey AND c.o_custkey % 3 = p.o_custkey % 3")
def _(t):
    child = t.orders.select(F.expr("o_orderkey div 4").alias("parent"), F.col("o_orderkey").alias("child"), (F.col("o_custkey") % 3).alias("g"))
    parent = t.orders.select(F.col("o_orderkey").alias("parent"), (F.col("o_custkey") % 3).alias("g"))
    return parent.join(child, ["parent", "g"]).where("parent <> child").select("parent", "child")


@query("version_chain", """
WITH RECURSIVE p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey // 4 <> o_orderkey AND o_orderkey // 4 IN (SELECT o_orderkey FROM orders) THEN o_orderkey // 4 END AS up FROM orders),
v AS (SELECT id, id AS root, 0::BIGINT AS depth FROM p WHERE up IS NULL UNION ALL SELECT p.id, v.root, v.depth + 1 FROM v JOIN p ON p.up = v.id) SELECT id, root, depth FROM v""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr("nullif(o_orderkey div 4, o_orderkey)").alias("parent"))
    return relational.chain_roots(rows, "id", "parent")


@query("known_value_mask", "SELECT doc_id, regexp_replace(regexp_replace(text, 'password\\s*=\\s*\\w+', '[SECRET]', 'g'), 'Released\\s+under\\s+the\\s+MIT\\s+License', '[LICENSE]', 'g') AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.mask(tx.mask(F.col("text"), r"password\s*=\s*\w+", "SECRET"), r"Released\s+under\s+the\s+MIT\s+License", "LICENSE").alias("text"))


@query("canonical_json", "SELECT event_id, '{\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') || 'Z\",\"kind\":\"' || event_type || '\",\"none\":null,\"user\":' || user_id || '}' AS body FROM events")
def _(t):
    rows = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("none"), F.col("user_id").alias("user"))
    return rows.select("event_id", sinks.canonical_json(["user", "kind", "at", "none"]).alias("body"))


@query("username_normalise", "SELECT c_custkey, lower(trim(regexp_replace('  ' || c_name || '  X ', '\\s+', ' ', 'g'))) AS name FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.lower(F.trim(F.regexp_replace(F.concat(F.lit("  "), "c_name", F.lit("  X ")), r"\s+", " "))).alias("name"))


@query("gpu_lines", "SELECT event_id, user_id AS used, (user_id * 2) AS total, round(value, 2) AS load FROM events")
def _(t):
    line = F.concat_ws(", ", F.col("user_id").cast("string"), (F.col("user_id") * 2).cast("string"), F.round("value", 2).cast("string"))
    parsed = F.from_csv(line, F.lit("used BIGINT, total BIGINT, load DOUBLE"), {"ignoreLeadingWhiteSpace": "true"})
    return t.events.select("event_id", parsed.alias("p")).select("event_id", "p.*")


@query("trailing_numbers", "SELECT s_suppkey, s_name AS label, s_nationkey::DOUBLE AS a, (s_suppkey * 3)::DOUBLE AS b FROM supplier")
def _(t):
    """A table row of a text page: a label that may hold spaces, then its numbers."""
    line, shape = F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") * 3).cast("string")), r"^(.*) (\S+) (\S+)$"
    return t.supplier.select("s_suppkey", F.regexp_extract(line, shape, 1).alias("label"), F.regexp_extract(line, shape, 2).cast("double").alias("a"), F.regexp_extract(line, shape, 3).cast("double").alias("b"))


@query("pages_without_text", "SELECT page_id FROM pages WHERE length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) < 400")
def _(t):
    return t.pages.where(F.char_length(F.trim(F.regexp_replace("html", "<[^>]*>", ""))) < 400).select("page_id")


@query("reading_order", """
WITH m AS (SELECT conv_id, max(turn) AS top FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, turn, (CASE WHEN role = 'user' THEN turn ELSE coalesce(top, -1) + row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) END)::BIGINT AS place FROM conversations LEFT JOIN m USING (conv_id)""")
def _(t):
    user = F.col("role") == "user"
    top = F.max(F.when(user, F.col("turn"))).over(Window.partitionBy("conv_id"))
    extra = F.row_number().over(Window.partitionBy("conv_id", user).orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.when(user, F.col("turn")).otherwise(F.coalesce(top, F.lit(-1)) + extra).cast("bigint").alias("place"))


@query("stream_accumulate", "SELECT user_id, event_type, string_agg(event_id::VARCHAR, '' ORDER BY event_id) AS body, sum(user_id)::BIGINT AS tokens FROM events GROUP BY 1, 2")
def _(t):
    pieces = F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string"))
    return t.events.groupBy("user_id", "event_type").agg(F.array_join(pieces, "").alias("body"), F.sum("user_id").alias("tokens"))


@query("argument_match", """
SELECT event_id, event_type IN ('click', 'view') AND CAST(props ->> '$.k' AS BIGINT) BETWEEN 10 AND 60 AND length(props) >= 5 AND (props ->> '$.z') IS NULL AS ok FROM events""")
def _(t):
    args = F.from_json("props", F.lit("k BIGINT, z STRING"))
    ok = F.col("event_type").isin("click", "view") & args["k"].between(10, 60) & (F.char_length("props") >= 5) & args["z"].isNull()
    return t.events.select("event_id", ok.alias("ok"))


@query("limits_capped", "SELECT c_custkey, least(c_custkey * 10, 500) AS max_rows, least(coalesce(nullif(c_nationkey, 3), 50), 50)::INT AS max_sheets FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.least(F.col("c_custkey") * 10, F.lit(500).cast("bigint")).alias("max_rows"), F.least(F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(50)), F.lit(50)).alias("max_sheets"))
