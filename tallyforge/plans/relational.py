"""Queries of joins, windows, sets, queues, chains and other relational patterns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import best_match, ordered, sheet
from ..operators import relational as rel
from .base import query


def money_sum(c):
    return F.sum(sheet.money(c)).cast("double")


@query("visible_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus <> 'F' AND o_orderdate + INTERVAL 1000 DAY > TIMESTAMP '1997-01-01'")
def _(t):
    return t.orders.where("o_custkey % 10 = 3 AND o_orderstatus <> 'F' AND o_orderdate + INTERVAL 1000 DAYS > TIMESTAMP_NTZ '1997-01-01'").select("o_orderkey", "o_custkey")


@query("rls_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(t):
    members = t.nation.select(F.col("n_nationkey").alias("space_id"), F.col("n_regionkey").alias("user_id"))
    return rel.secured(t.customer, members, 2, "c_nationkey").select("c_custkey", "c_name")


@query("valid_tokens", "SELECT event_id FROM events WHERE event_type <> 'purchase' AND ts > TIMESTAMP '2024-01-10' AND value > 10")
def _(t):
    return t.events.where("event_type <> 'purchase' AND ts > TIMESTAMP_NTZ '2024-01-10' AND value > 10").select("event_id")


@query("active_sessions", """
WITH s AS (SELECT user_id, max(ts) AS last_seen, min(ts) AS created FROM events GROUP BY 1)
SELECT s.user_id, c_name FROM s JOIN customer ON c_custkey = s.user_id
WHERE c_acctbal > 0 AND created + INTERVAL 30 DAY > TIMESTAMP '2024-01-30' AND last_seen + INTERVAL 5 DAY >= TIMESTAMP '2024-01-30'""")
def _(t):
    s = t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.min("ts").alias("created"))
    ok = s.where("created + INTERVAL 30 DAYS > TIMESTAMP_NTZ '2024-01-30' AND last_seen + INTERVAL 5 DAYS >= TIMESTAMP_NTZ '2024-01-30'")
    return ok.join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("user_id")).select("user_id", "c_name")


@query("case_priority", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'deactivated' WHEN c_custkey % 11 = 0 THEN 'invited' WHEN c_custkey % 7 = 0 THEN 'locked' ELSE 'active' END AS state FROM customer")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select(k, F.when(F.col("c_acctbal") < 0, "deactivated").when(k % 11 == 0, "invited").when(k % 7 == 0, "locked").otherwise("active").alias("state"))


@query("json_filter", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE CAST(props ->> '$.k' AS BIGINT) > 50")
def _(t):
    return t.events.withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint")).where("k > 50").select("event_id", "k")


@query("budget_prefix", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 600")
def _(t):
    return rel.budget_prefix(t.conversations, "conv_id", ["turn"], F.char_length("text"), 600).select("conv_id", "turn")


@query("budget_choice", """
WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, CASE WHEN size <= 600 THEN size ELSE 0 END AS used, size <= 600 AS taken FROM r WHERE n = 1
      UNION ALL SELECT r.conv_id, r.turn, r.n, f.used + CASE WHEN f.used + r.size <= 600 THEN r.size ELSE 0 END, f.used + r.size <= 600 FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM f WHERE taken""")
def _(t):
    return ordered.budget_choice(t.conversations.withColumn("size", F.char_length("text")), "conv_id", ["size", "turn"], "turn", "size", 600).select("conv_id", "turn")


@query("join_members", "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("join_null_safe", """
SELECT a.c_custkey, b.n FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a
LEFT JOIN (SELECT nullif(s_nationkey, 3) AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""")
def _(t):
    a = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = t.supplier.groupBy(F.nullif("s_nationkey", F.lit(3)).alias("bk")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, F.col("k").eqNullSafe(F.col("bk")), "left").select("c_custkey", "n")


@query("correlated_count", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS owners FROM nation")
def _(t):
    owners = t.customer.where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("owners"))
    return t.nation.join(owners, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.coalesce("owners", F.lit(0)).alias("owners"))


@query("semi_join_spaces", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY')")
def _(t):
    return t.orders.join(t.customer.where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("anti_join_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("anti_join_uncached", """
SELECT l_suppkey AS sheet, count(*) AS n FROM lineitem l WHERE l_quantity > 40
AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_returnflag = 'R' AND c.l_suppkey = l.l_suppkey AND c.l_partkey = l.l_partkey) GROUP BY 1""")
def _(t):
    cached = t.lineitem.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey")
    return t.lineitem.where("l_quantity > 40").join(cached, ["l_suppkey", "l_partkey"], "left_anti").groupBy(F.col("l_suppkey").alias("sheet")).agg(F.count(F.lit(1)).alias("n"))


@query("nest_children", """
SELECT conv_id, count(*) AS n, string_agg(role, '|' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def _(t):
    rows = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda x: x["role"]), "|").alias("roles"))


@query("zip_join", """
WITH a AS (SELECT c_nationkey AS g, c_custkey AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
b AS (SELECT s_nationkey AS g, s_suppkey AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT g, n, x, y FROM a JOIN b USING (g, n)""")
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("x")).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("x")))
    b = t.supplier.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("y")).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("y")))
    return a.join(b, ["g", "n"])


@query("chain_links", "SELECT a.event_id, a.event_type, b.event_type AS before FROM events a JOIN events b ON a.event_id = b.event_id + 1 WHERE a.event_type <> b.event_type")
def _(t):
    before = t.events.select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("before"))
    return t.events.select("event_id", "event_type").join(before, "event_id").where("event_type <> before")


_CHAIN = """
WITH e AS (SELECT event_id AS seq, sha256(event_id::VARCHAR || '|' || event_type) AS good FROM events),
c AS (SELECT seq, CASE WHEN seq % 97 = 0 THEN 'x' ELSE coalesce(lag(good) OVER (ORDER BY seq), '') END AS prev_hash,
             CASE WHEN seq % 89 = 0 THEN 'bad' ELSE good END AS hash, good FROM e WHERE seq % 101 <> 5)"""


def _chain(t):
    good = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    kept = t.events.where("event_id % 101 <> 5").select(F.col("event_id").alias("seq"), good.alias("good"), F.floor(F.col("event_id") / 1000).alias("part"))
    # the test chain itself: the predecessor's hash, by the last kept row before
    w = Window.partitionBy("part").orderBy("seq")
    edge = kept.groupBy("part").agg(F.max_by("good", "seq").alias("edge")).select((F.col("part") + 1).alias("part"), "edge")
    linked = kept.join(F.broadcast(edge), "part", "left").withColumn("before", F.coalesce(F.lag("good").over(w), "edge", F.lit("")))
    return linked.select("seq", F.when(F.col("seq") % 97 == 0, "x").otherwise(F.col("before")).alias("prev_hash"), F.when(F.col("seq") % 89 == 0, "bad").otherwise(F.col("good")).alias("hash"), "good")


@query("hash_chain_verify", _CHAIN + """
SELECT seq, reason FROM (SELECT c.seq, CASE WHEN c.seq > (SELECT min(seq) FROM c) AND p.seq IS NULL THEN 'GAP'
  WHEN c.seq > (SELECT min(seq) FROM c) AND p.hash <> c.prev_hash THEN 'PREV_HASH' WHEN c.hash <> c.good THEN 'HASH' END AS reason
  FROM c LEFT JOIN c p ON p.seq = c.seq - 1) WHERE reason IS NOT NULL""")
def _(t):
    return rel.chain_failures(_chain(t), F.col("good"))


_AUDIT = """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type || '|' || event_id AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
c AS (SELECT user_id, event_id, body, seq, '' AS prev_hash, sha256(body) AS hash FROM e WHERE seq = 1
      UNION ALL SELECT e.user_id, e.event_id, e.body, e.seq, c.hash, sha256(c.hash || e.body) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)"""


def _audit(t):
    return ordered.append_chain(t.events.select("user_id", "event_id", "event_type"), "user_id", ["event_id"], F.concat_ws("|", "event_type", F.col("event_id").cast("string")))


@query("audit_append", _AUDIT + " SELECT user_id, event_id, seq, prev_hash, hash FROM c")
def _(t):
    return _audit(t).select("user_id", "event_id", F.col("seq").cast("bigint").alias("seq"), "prev_hash", "hash")


@query("audit_first_failure", _AUDIT + """,
b AS (SELECT user_id, seq, body, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE prev_hash END AS prev_hash, CASE WHEN event_id % 11 = 0 THEN 'y' ELSE hash END AS hash FROM c WHERE event_id % 13 <> 0),
f AS (SELECT b.user_id, b.seq, CASE WHEN b.seq > 1 AND p.hash IS NULL THEN 'GAP' WHEN coalesce(p.hash, '') <> b.prev_hash THEN 'PREV_HASH' WHEN sha256(b.prev_hash || b.body) <> b.hash THEN 'HASH' END AS reason
      FROM b LEFT JOIN b p ON p.user_id = b.user_id AND p.seq = b.seq - 1)
SELECT user_id, min(seq) AS seq, arg_min(reason, seq) AS reason FROM f WHERE reason IS NOT NULL GROUP BY 1""")
def _(t):
    broken = _audit(t).where("event_id % 13 <> 0").withColumn("prev_hash", F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("prev_hash"))).withColumn("hash", F.when(F.col("event_id") % 11 == 0, "y").otherwise(F.col("hash")))
    return rel.first_failure(broken, "user_id", F.concat_ws("|", "event_type", F.col("event_id").cast("string"))).withColumn("seq", F.col("seq").cast("bigint"))


@query("row_hash", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"seq\":' || event_id || ',\"user_id\":' || user_id || '}') AS hash FROM events")
def _(t):
    body = F.to_json(F.struct("event_type", F.col("event_id").alias("seq"), "user_id"), {"ignoreNullFields": "false"})
    return t.events.select("event_id", F.sha2(body, 256).alias("hash"))


@query("align_best_match", """
SELECT a.vec_id, b.vec_id AS best FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) DESC, b.vec_id) = 1""")
def _(t):
    return best_match.best_match(t.embeddings, "vec_id", F.col("label"), F.col("embedding"))


@query("last_started", "SELECT user_id, max(ts) AS last_started FROM events WHERE ts > TIMESTAMP '2024-01-29' GROUP BY 1")
def _(t):
    return t.events.where("ts > TIMESTAMP_NTZ '2024-01-29'").groupBy("user_id").agg(F.max("ts").alias("last_started"))


@query("claim_next", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def _(t):
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select(F.col("o_orderkey").alias("id"))


@query("claim_fair", """
SELECT id FROM (SELECT o_orderkey AS id, nullif(o_custkey, 7) AS u, o_orderpriority AS p, o_orderdate AS r FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-06-01') j
LEFT JOIN (SELECT nullif(o_custkey, 7) AS u, max(o_orderdate) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) l ON j.u IS NOT DISTINCT FROM l.u
ORDER BY p, s NULLS FIRST, r, id LIMIT 1""")
def _(t):
    user = F.nullif("o_custkey", F.lit(7)).alias("user_id")
    jobs = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), user, F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("run_after"))
    started = t.orders.where("o_orderstatus = 'F'").select(user, F.col("o_orderdate").alias("started_at"))
    return rel.claim_fair(jobs, started, F.expr("TIMESTAMP_NTZ '1997-06-01'")).select("id")


@query("round_robin", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS turn FROM orders")
def _(t):
    return rel.round_robin(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "turn")


@query("yoy_growth", """
WITH y AS (SELECT year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS v FROM orders GROUP BY 1)
SELECT y AS year, round((v - lag(v) OVER (ORDER BY y)) / abs(lag(v) OVER (ORDER BY y)) * 100, 4) AS growth FROM y""")
def _(t):
    y = t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("year")).agg(money_sum("o_totalprice").alias("v"))
    before = F.lag("v").over(Window.partitionBy(F.lit(1)).orderBy("year"))  # one row per year
    return y.select("year", F.round((F.col("v") - before) / F.abs(before) * 100, 4).alias("growth"))


@query("failure_runs", """
WITH r AS (SELECT *, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT event_id, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id)::BIGINT AS failures FROM r""")
def _(t):
    return rel.failure_runs(t.events, "user_id", ["event_id"], F.col("value") < 50).select("event_id", F.col("failures").cast("bigint").alias("failures"))


@query("best_per_key", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type, event_id) AS n FROM events) WHERE n = 1")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_type", "event_id")
    return t.events.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "value")


@query("merge_intervals", """
WITH s AS (SELECT l_suppkey AS k, l_partkey AS a, l_partkey + l_quantity::BIGINT AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, min(a) AS a, max(b) AS b FROM i GROUP BY k, island""")
def _(t):
    """Quantities are rounded, halves to even, as the SQL's cast does."""
    return rel.merge_intervals(t.lineitem.selectExpr("l_suppkey AS k", "l_partkey AS a", "l_partkey + CAST(rint(l_quantity) AS BIGINT) AS b"), "k", "a", "b")


@query("ordinal", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))


@query("allocate_remainder", """
WITH w AS (SELECT c_nationkey AS g, c_custkey AS k, 1 + c_custkey % 5 AS w FROM customer),
p AS (SELECT *, floor(10000.0 * w / sum(w) OVER (PARTITION BY g))::BIGINT AS part, row_number() OVER (PARTITION BY g ORDER BY k DESC) AS last FROM w)
SELECT g, k, CASE WHEN last = 1 THEN 10000 - (sum(part) OVER (PARTITION BY g) - part) ELSE part END::BIGINT AS amount FROM p""")
def _(t):
    g = Window.partitionBy("g")
    rows = t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), (F.col("c_custkey") % 5 + 1).alias("w"))
    parts = rows.withColumn("part", F.floor(F.lit(10000.0) * F.col("w") / F.sum("w").over(g))).withColumn("last", F.row_number().over(g.orderBy(F.desc("k"))))
    return parts.select("g", "k", F.when(F.col("last") == 1, 10000 - (F.sum("part").over(g) - F.col("part"))).otherwise(F.col("part")).cast("bigint").alias("amount"))


@query("keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-01-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def _(t):
    return rel.keyset_page(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], (F.expr("TIMESTAMP_NTZ '1996-01-01'"), F.lit(5000).cast("bigint")), 20)


@query("latest_row", "SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("enum_sort", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey")
def _(t):
    return t.orders.orderBy(F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), "o_orderdate", "o_orderkey").select("o_orderkey")


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.selectExpr("c_nationkey AS k").unionAll(t.supplier.selectExpr("s_nationkey AS k"))


@query("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(t):
    return t.part.selectExpr("p_partkey AS k").subtract(t.lineitem.where("l_quantity > 45").selectExpr("l_partkey AS k"))


@query("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return t.customer.selectExpr("c_custkey AS k").intersect(t.orders.where("o_orderstatus = 'P'").selectExpr("o_custkey AS k"))


@query("array_distinct", "SELECT user_id, array_to_string(list(event_type ORDER BY first), ',') AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    seen = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return t.events.groupBy("user_id").agg(F.array_join(F.array_distinct(seen), ",").alias("types"))


@query("ordered_distinct", "SELECT user_id, array_to_string(list(event_type ORDER BY first), ',') AS types FROM (SELECT user_id, event_type, min(ts) AS first FROM events WHERE value > 20 GROUP BY 1, 2) GROUP BY 1")
def _(t):
    first = t.events.where("value > 20").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


@query("version_diff", """
WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0)
SELECT k, a.v AS old, b.v AS new, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def _(t):
    old = t.customer.where("c_custkey % 5 <> 0").selectExpr("c_custkey AS k", "c_mktsegment AS v")
    new = t.customer.where("c_custkey % 7 <> 0").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS v")
    return rel.version_diff(old, new, "k", "v")


@query("array_agg", "SELECT n_nationkey, coalesce(array_to_string(list_sort(list(DISTINCT s_suppkey) FILTER (s_suppkey IS NOT NULL)), ','), '') AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(t):
    members = t.supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_set("s_suppkey")).alias("m"))
    return t.nation.join(members, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce(F.array_join(F.col("m").cast("array<string>"), ","), F.lit("")).alias("members"))


@query("space_counts", "SELECT n_regionkey, count(*) FILTER (n_nationkey % 2 = 0) AS shared, count(*) FILTER (n_nationkey % 2 = 1) AS personal FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.count_if(F.col("n_nationkey") % 2 == 0).alias("shared"), F.count_if(F.col("n_nationkey") % 2 == 1).alias("personal"))


@query("exact_duplicates", "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) WHERE doc_id <> first_id")
def _(t):
    h = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").where("doc_id <> first_id").select("doc_id", "first_id")


@query("range_join_grounding", """
WITH s AS (SELECT DISTINCT 'NUMBER' AS dim, round(l_extendedprice, 0) AS key FROM lineitem), f AS (SELECT o_orderkey AS id, 'NUMBER' AS dim, o_totalprice AS v FROM orders)
SELECT id, count(*) AS n FROM f JOIN s ON s.dim = f.dim AND s.key >= f.v - 5 AND s.key < f.v + 5 GROUP BY 1""")
def _(t):
    values = t.lineitem.select(F.lit("NUMBER").alias("dim"), F.round("l_extendedprice", 0).alias("key")).distinct()
    figures = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("NUMBER").alias("dim"), (F.col("o_totalprice") - 5).alias("lo"), (F.col("o_totalprice") + 5).alias("hi"))
    return rel.range_join(values, figures).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("range_containment", """
WITH e AS (SELECT l_suppkey AS s, l_orderkey AS id, l_linenumber AS r0, l_linenumber + 1 AS r1 FROM lineitem), c AS (SELECT l_suppkey AS s, min(l_linenumber) AS r0, max(l_linenumber) AS r1 FROM lineitem WHERE l_quantity < 10 GROUP BY 1)
SELECT id, e.s, e.r0 FROM e JOIN c ON e.s = c.s AND c.r0 <= e.r0 AND c.r1 >= e.r1""")
def _(t):
    asked = t.lineitem.selectExpr("l_suppkey AS s", "l_orderkey AS id", "l_linenumber AS r0", "l_linenumber + 1 AS r1")
    cited = t.lineitem.where("l_quantity < 10").groupBy(F.col("l_suppkey").alias("s")).agg(F.min("l_linenumber").alias("c0"), F.max("l_linenumber").alias("c1"))
    return asked.join(cited, "s").where("c0 <= r0 AND c1 >= r1").select("id", "s", "r0")


@query("span_containment", """
WITH s AS (SELECT doc_id, unnest(range(0, 10)) AS i FROM documents)
SELECT doc_id, i FROM s WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(0, 4)) AS b) WHERE s.i * 7 >= b * 20 AND s.i * 7 + 5 <= b * 20 + 12)""")
def _(t):
    spans = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("i"), (i * 7).alias("a"), (i * 7 + 5).alias("b")))
    benign = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.struct((b * 20).alias("a"), (b * 20 + 12).alias("b")))
    kept = F.filter(spans, lambda s: ~F.exists(benign, lambda x: (s["a"] >= x["a"]) & (s["b"] <= x["b"])))
    return t.documents.select("doc_id", F.explode(F.transform(kept, lambda s: s["i"].cast("bigint"))).alias("i"))


@query("incremental_since", "SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_id > (SELECT max(event_id) * 3 // 4 FROM events)")
def _(t):
    mark = t.events.agg(F.expr("max(event_id) * 3 div 4").alias("mark"))
    return t.events.crossJoin(F.broadcast(mark)).where("event_id > mark").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))  # one row


@query("partition_anchors", "SELECT strftime(o_orderdate, '%Y-%m') AS month, max(o_orderkey) AS last_seq, sha256(max(o_orderkey)::VARCHAR) AS last_hash FROM orders GROUP BY 1")
def _(t):
    rows = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey")
    return rows.groupBy("month").agg(F.max("o_orderkey").alias("last_seq")).withColumn("last_hash", F.sha2(F.col("last_seq").cast("string"), 256))


@query("expired_months", "SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE date_trunc('month', o_orderdate) < TIMESTAMP '1998-06-01' - INTERVAL 36 MONTH")
def _(t):
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return t.orders.select(month.alias("month")).where(F.col("month") < F.add_months(F.lit("1998-06-01").cast("date"), -36)).distinct()


@query("idle_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, n""")
def _(t):
    return t.events.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("events")).drop("w")


@query("retention_status", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 365 DAY <= TIMESTAMP '1997-01-01' THEN 'expired' WHEN o_orderdate + INTERVAL 358 DAY <= TIMESTAMP '1997-01-01' THEN 'warn' ELSE 'kept' END AS status FROM orders")
def _(t):
    now = "TIMESTAMP_NTZ '1997-01-01'"
    return t.orders.select("o_orderkey", F.expr(f"CASE WHEN o_orderdate + INTERVAL 365 DAYS <= {now} THEN 'expired' WHEN o_orderdate + INTERVAL 358 DAYS <= {now} THEN 'warn' ELSE 'kept' END").alias("status"))


@query("reap_leases", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-01-01' THEN CASE WHEN o_orderkey % 3 < 2 THEN 'queued' ELSE 'failed' END ELSE 'unchanged' END AS status FROM orders")
def _(t):
    late = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1995-01-01'"))
    return t.orders.select("o_orderkey", F.when(late, F.when(F.col("o_orderkey") % 3 < 2, "queued").otherwise("failed")).otherwise("unchanged").alias("status"))


@query("rate_limit_windows", "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) <= 2 AS allowed FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("hour"), "n", (F.col("n") <= 2).alias("allowed"))


@query("rate_limit_events", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) <= 2 AS allowed FROM events")
def _(t):
    w = Window.partitionBy("user_id", F.window("ts", "1 day")).orderBy("event_id")
    return t.events.select("event_id", (F.row_number().over(w) <= 2).alias("allowed"))


@query("fold_events", """
WITH r AS (SELECT conv_id, max(turn) FILTER (turn % 4 = 0) AS cut FROM conversations GROUP BY 1)
SELECT c.conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations c JOIN r USING (conv_id) WHERE turn >= coalesce(cut, 0) GROUP BY 1""")
def _(t):
    # every fourth turn replaces what came before; the others append
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))
    fold = F.aggregate(ordered, F.lit(""), lambda acc, x: F.when(x["turn"] % 4 == 0, x["text"]).otherwise(F.concat(acc, x["text"])))
    return t.conversations.groupBy("conv_id").agg(fold.alias("text"))


@query("usage_counts", "SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-23') AS week, count(*) FILTER (ts >= TIMESTAMP '2023-12-31') AS month FROM events GROUP BY 1")
def _(t):
    since = lambda d: F.count_if(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{d}'"))
    return t.events.groupBy("event_type").agg(since("2024-01-23").alias("week"), since("2023-12-31").alias("month"))


@query("chunk_rows", "SELECT conv_id, turn // 3 AS chunk, string_agg(role, ' ' ORDER BY turn) AS body FROM conversations GROUP BY 1, 2")
def _(t):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t.conversations.groupBy("conv_id", F.expr("turn div 3").alias("chunk")).agg(F.array_join(rows, " ").alias("body"))


@query("values_only", "SELECT c_custkey, CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END AS v FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '=' || c_name WHEN c_custkey % 3 = 1 THEN '-' || c_name ELSE c_name END AS v FROM customer)")
def _(t):
    v = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("="), "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("-"), "c_name")).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", tx.values_only(v).alias("v"))
