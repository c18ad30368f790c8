"""Queries of logins, tool calls, known values, paragraphs and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calc, crypto, guard
from ..functions import json_schema as js
from ..operators import known_values, notes, ordered, paragraphs, relational, tool_calls
from ..sources import sinks, xlsx
from .base import query


@query("login_locks", """
WITH RECURSIVE r AS (SELECT event_id, user_id, ts, event_type IN ('purchase', 'signup') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, 0 AS failures, NULL::TIMESTAMP AS until FROM events
      UNION ALL SELECT r.user_id, r.n, r.event_id, CASE WHEN f.until > r.ts THEN 'locked' WHEN r.ok THEN 'ok' ELSE 'failed' END,
        CASE WHEN f.until > r.ts THEN f.failures WHEN r.ok THEN 0 WHEN f.until IS NOT NULL THEN 1 ELSE f.failures + 1 END,
        CASE WHEN f.until > r.ts THEN f.until WHEN NOT r.ok AND f.until IS NULL AND f.failures + 1 >= 3 THEN r.ts + INTERVAL 2 DAY END
      FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT event_id, user_id, outcome, failures, until AS locked_until FROM f WHERE n > 0""")
def _(t):
    """Purchases and signups stand for right passwords; three failures lock for two days."""
    attempts = t.events.select("event_id", "user_id", "ts", F.col("event_type").isin("purchase", "signup").alias("ok"))
    return ordered.login_locks(attempts, "user_id", "ts", "ok", ["event_id"], 3, 2 * 24 * 60).drop("ts", "ok")


_CHUNKS = """
c AS (SELECT user_id AS s, event_id AS q, CASE WHEN event_type = 'view' THEN props END AS content, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 3 END AS i,
             CASE WHEN event_id % 5 = 0 THEN 'id' || event_id ELSE '' END AS id, CASE WHEN event_id % 7 = 0 THEN event_type END AS name, props AS args, CASE WHEN event_type = 'signup' THEN 'stop' || event_id END AS finish FROM events)"""


@query("tool_call_deltas", f"""
WITH {_CHUNKS},
k AS (SELECT s, i, coalesce(arg_max(id, q) FILTER (id <> ''), '') AS id, coalesce(string_agg(name, '' ORDER BY q), '') AS name, coalesce(string_agg(args, '' ORDER BY q), '') AS args FROM c WHERE i IS NOT NULL GROUP BY 1, 2),
j AS (SELECT s, string_agg(i || ':' || id || ':' || name || ':' || args, ';' ORDER BY i) AS calls FROM k GROUP BY 1)
SELECT s AS stream, body, coalesce(calls, '') AS calls, finish, finish IS NULL AS interrupted
FROM (SELECT s, coalesce(string_agg(content, '' ORDER BY q), '') AS body, arg_max(finish, q) FILTER (finish IS NOT NULL) AS finish FROM c GROUP BY 1) LEFT JOIN j USING (s)""")
def _(t):
    kind = F.col("event_type")
    chunks = t.events.select(
        F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.when(kind == "view", F.col("props")).alias("content"), F.when(kind.isin("click", "purchase"), F.col("event_id") % 3).alias("index"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("id"), "event_id")).otherwise("").alias("id"), F.when(F.col("event_id") % 7 == 0, kind).alias("name"), F.col("props").alias("args"),
        F.when(kind == "signup", F.concat(F.lit("stop"), "event_id")).alias("finish"),
    )
    line = F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["index"].cast("string"), c["id"], c["name"], c["args"])), ";")
    return tool_calls.assemble(chunks).withColumn("calls", line)


def _document(t):
    """An event as the arguments of a call."""
    text = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "user": '), F.col("user_id").cast("string"), F.lit(', "amount": '), F.col("value").cast("string"), F.lit(', "args": '), "props", F.lit(', "pair": ["'), "event_type", F.lit('", '), F.col("user_id").cast("string"), F.lit("]}"))
    return t.events.select("event_id", js.parsed(text).alias("v"))


_SCHEMA = {
    "type": "object", "required": ["kind", "when"], "additionalProperties": False,
    "properties": {
        "kind": {"type": "string", "enum": ["click", "view", "error"], "maxLength": 4}, "user": {"type": "integer", "minimum": 20}, "amount": {"type": "number", "exclusiveMinimum": 10},
        "args": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 50}}}, "pair": {"type": "array", "maxItems": 1, "items": {"type": "integer", "minimum": 40}},
    },
}


@query("schema_errors", """
SELECT event_id, array_to_string(list_filter(['$.when: missing',
  CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN '$.kind: not one of [''click'', ''view'', ''error'']' WHEN length(event_type) > 4 THEN '$.kind: bad length' END,
  CASE WHEN user_id < 20 THEN '$.user: below minimum' END, CASE WHEN value <= 10 THEN '$.amount: not above minimum' END,
  CASE WHEN CAST(props ->> '$.k' AS BIGINT) < 50 THEN '$.args.k: below minimum' END,
  '$.pair: too many items', '$.pair[0]: not an integer', CASE WHEN user_id < 40 THEN '$.pair[1]: below minimum' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events""")
def _(t):
    return _document(t).select("event_id", F.array_join(js.errors(_SCHEMA, F.col("v")), "; ").alias("errors"))


_MATCHERS = {
    "equals": ("kind", {"equals": " CLICK "}), "one_of": ("user", {"one_of": ["5", 1_00, 12]}), "contains_any": ("kind", {"contains_any": ["IC", "rch"]}), "range": ("amount", {"range": [5, 12.5]}),
    "length": ("pair", {"length": 2}), "present": ("none", {"present": False}), "contains": ("pair", {"contains": ["View"]}), "items": ("pair", {"items": [{"x": {"present": False}}]}), "both": ("user", {"present": True, "range": [10, 50]}),
}


@query("argument_matchers", """
SELECT event_id, event_type = 'click' AS equals, user_id IN (5, 100, 12) AS one_of, event_type LIKE '%ic%' OR event_type LIKE '%rch%' AS contains_any, value BETWEEN 5 AND 12.5 AS range,
       true AS length, true AS present, event_type = 'view' AS contains, true AS items, user_id BETWEEN 10 AND 50 AS both FROM events""")
def _(t):
    return _document(t).select("event_id", *[js.matches(m, js.field(F.col("v"), name)).alias(k) for k, (name, m) in _MATCHERS.items()])


@query("tool_scores", """
SELECT event_id, failure IS NULL OR failure NOT IN ('unknown_tool', 'schema') AS valid, event_type = 'click' AS right_tool, failure IS NULL AS right_args, failure,
       CASE failure WHEN 'unknown_tool' THEN event_type WHEN 'wrong_tool' THEN event_type WHEN 'schema' THEN '$.k: below minimum' WHEN 'wrong_args' THEN 'k' ELSE '' END AS detail
FROM (SELECT *, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown_tool' WHEN k < 20 THEN 'schema' WHEN event_type <> 'click' THEN 'wrong_tool' WHEN k > 80 THEN 'wrong_args' END AS failure
      FROM (SELECT event_id, event_type, CAST(props ->> '$.k' AS BIGINT) AS k FROM events))""")
def _(t):
    """Events as tool calls: the type is the tool, props are the arguments; a click with k up to 80 is expected."""
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 20}}}
    answers = t.events.select("event_id", F.lit("a").alias("case"), F.col("event_type").alias("name"), F.col("props").alias("args"), F.lit(None).cast("string").alias("content"))
    return tool_calls.score(answers, {"click": schema, "view": schema}, {"a": {"tool": "click", "args": {"k": {"range": [0, 80]}}}}).drop("case", "name", "args", "content")


@query("known_values_masked", r"""
WITH e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+[a-z0-9]')) AS v, 'EMAIL' AS label FROM documents
           UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[+]?[0-9][0-9 -]{8,14}[0-9]')), 'PHONE' FROM documents),
k AS (SELECT DISTINCT regexp_replace(lower(v), '\s', '', 'g') AS v, label FROM e),
p AS (SELECT list({'w': array_to_string(list_transform(string_split(v, ''), lambda c: regexp_escape(c)), '\s*'), 'l': label} ORDER BY length(v) DESC, v, label) AS ps FROM k)
SELECT doc_id, CASE WHEN ps IS NULL THEN text ELSE list_reduce(list_prepend({'w': text, 'l': ''}, ps), lambda a, x: {'w': regexp_replace(a.w, x.w, '[' || x.l || ']', 'gi'), 'l': ''}).w END AS text FROM documents, p""")
def _(t):
    """E-mail addresses and telephone numbers that any document has are masked in all of them."""
    found = lambda pattern, label, docs=t.documents: docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("value"), F.lit(label).alias("label"))
    values = found(r"[a-z0-9.]+@[a-z0-9.]+[a-z0-9]", "email", t.documents.where(F.contains("text", F.lit("@")))).unionAll(found(r"[+]?[0-9][0-9 -]{8,14}[0-9]", "phone"))
    return known_values.mask_known(t.documents.select("doc_id", "text"), "text", values)


_LINES = """
l AS (SELECT doc_id, generate_subscripts(p, 1) AS n, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
i AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, CASE WHEN n % 5 = 0 THEN line || ' x' ELSE line END AS line FROM l WHERE n % 3 <> 0),
plain AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l)"""


@query("paragraph_places", f"""
WITH RECURSIVE {_LINES},
f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, NULL::BIGINT AS n, 0::BIGINT AS last FROM l
      UNION ALL SELECT i.doc_id, i.k, i.n, coalesce(min(plain.n), f.last) FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1
        LEFT JOIN plain ON plain.doc_id = f.doc_id AND plain.n > f.last AND plain.line = trim(regexp_replace(i.line, '\\s+', ' ', 'g')) GROUP BY i.doc_id, i.k, i.n, f.last)
SELECT doc_id, n::INT AS n, greatest(last, 1)::INT AS para FROM f WHERE k > 0""")
def _(t):
    """Two of three lines of each document as items, some of them changed, among all its lines."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    items = lines.where("n % 3 <> 0").withColumn("line", F.when(F.col("n") % 5 == 0, F.concat("line", F.lit(" x"))).otherwise(F.col("line")))
    return paragraphs.locate(items, lines, "doc_id", "n", "line").select("doc_id", "n", "para")


@query("packed_turns", """
WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, 1 AS pack, size AS used FROM r WHERE n = 1
      UNION ALL SELECT r.conv_id, r.turn, r.n, CASE WHEN f.used + r.size <= 900 THEN f.pack ELSE f.pack + 1 END, CASE WHEN f.used + r.size <= 900 THEN f.used + r.size ELSE r.size END
      FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, turn, pack FROM f""")
def _(t):
    turns = t.conversations.select("conv_id", "turn", F.char_length("text").alias("size"))
    return ordered.packed(turns, ["conv_id"], ["turn"], "size", 900).drop("size")


@query("merged_notes")
def _(t):
    """Conversations as notes, merged under 1,200 characters a pack; a merged note has the first 120 characters of each."""
    joined = lambda texts: F.array_join(F.transform(texts, lambda x: F.substring(x, 1, 120)), "\n")
    return notes.merge_tree(t.conversations, ["conv_id"], ["turn"], "text", "turn", 1200, joined)


@query("encrypted_columns", "SELECT c_custkey, c_mktsegment, c_name, c_acctbal, false AS plain FROM customer")
def _(t):
    """Names and balances are sealed under their segment's key, the master key is changed, and they are opened again."""
    old, new = bytes(32), bytes([7] * 32)
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_name", "c_acctbal")
    keys = crypto.new_keys(rows.select(F.col("c_mktsegment").alias("sheet")), old)
    hidden = crypto.encrypted(rows.withColumn("_name", F.col("c_name").cast("binary")), "c_mktsegment", ["c_name", "c_acctbal"], keys, old)
    marked = hidden.withColumn("plain", F.contains("c_name", "_name")).drop("_name")
    return crypto.decrypted(marked, "c_mktsegment", {"c_name": "string", "c_acctbal": "double"}, crypto.rotated(keys, old, new), new)


@query("grid_records", """
SELECT l_returnflag AS sheet, year(l_shipdate) || '/' || quarter(l_shipdate) AS above, l_linestatus AS beside, count(*)::VARCHAR AS text FROM lineitem GROUP BY 1, 2, 3""")
def _(t):
    """Counts as a table with years over quarters and one row a status, read back with their headers."""
    at = t.lineitem.select(F.col("l_returnflag").alias("sheet"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"))
    row, col = F.ascii("status"), (F.col("y") - 1900) * 4 + F.col("q")
    cell = lambda r, c, span, text, header: [r.cast("int").alias("row"), c.cast("int").alias("col"), F.lit(1).alias("row_span"), F.lit(span).alias("col_span"), text.cast("string").alias("text"), F.lit(header).alias("header")]
    counts = at.groupBy("sheet", "status", "y", "q").count()
    cells = (
        counts.select("sheet", *cell(row, col, 1, F.col("count"), False))
        .unionAll(at.select("sheet", "y").distinct().select("sheet", *cell(F.lit(0), (F.col("y") - 1900) * 4 + 1, 4, F.col("y"), True)))
        .unionAll(at.select("sheet", "y", "q").distinct().select("sheet", *cell(F.lit(1), col, 1, F.col("q"), True)))
        .unionAll(at.select("sheet", "status").distinct().select("sheet", *cell(row, F.lit(0), 1, F.col("status"), True)))
    )
    return xlsx.grid_records(cells, "sheet").select("sheet", F.array_join("above", "/").alias("above"), F.array_join("beside", "/").alias("beside"), "text")


@query("job_of_owner", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)")
def _(t):
    """An order looked up by its id and its own customer."""
    owner = t.orders.where("o_orderkey = 7").select(F.col("o_custkey").alias("me"))
    rows = t.orders.join(F.broadcast(owner))  # one row
    return relational.owned(rows, "o_orderkey", 7, "o_custkey", F.col("me")).select("o_orderkey", "o_orderstatus")


@query("guard_outputs", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'safe' WHEN 'click' THEN 'unsafe' ELSE 'controversial' END AS safety,
       CASE WHEN event_type NOT IN ('view', 'click', 'signup') THEN 'parse_error' WHEN user_id % 2 = 0 THEN 'A b,Zed' ELSE '' END AS categories,
       CASE WHEN event_type IN ('view', 'click', 'signup') AND value > 20 THEN value > 50 END AS refusal FROM events""")
def _(t):
    safety = F.when(F.col("event_type") == "view", "SAFE").when(F.col("event_type") == "click", "unsafe").when(F.col("event_type") == "signup", "Controversial").otherwise("maybe")
    refusal = F.when(F.col("value") > 50, "\nRefusal: Yes").when(F.col("value") > 20, "\nRefusal: no ").otherwise("\nRefusal: perhaps")
    text = F.concat(F.lit("  safety: "), safety, F.lit("\nCategories: "), F.when(F.col("user_id") % 2 == 0, "Zed, A b , none, Zed").otherwise("None"), refusal)
    return t.events.select("event_id", guard.guard_output(text).alias("g")).select("event_id", "g.safety", F.array_join("g.categories", ",").alias("categories"), "g.refusal")


@query("feature_verdicts", """
SELECT user_id, CASE WHEN same IS NULL OR other IS NULL OR same <= 0 THEN 'inconclusive' WHEN other > 0 THEN 'ignored' ELSE 'honoured' END AS salt,
       CASE WHEN rejected IS NOT NULL THEN 'unsupported' WHEN high IS NULL OR mid IS NULL THEN 'inconclusive' WHEN high < mid * 0.5 THEN 'honoured' ELSE 'ignored' END AS priority
FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS same, CASE WHEN user_id % 3 > 0 THEN count(*) FILTER (event_type = 'view' AND value > 80) END AS other,
             min(value) FILTER (event_type = 'signup') AS high, median(value) FILTER (event_type = 'error') AS mid, CASE WHEN user_id % 7 = 0 THEN 503 END AS rejected FROM events GROUP BY 1)""")
def _(t):
    kind = F.col("event_type")
    counters = t.events.groupBy("user_id").agg(
        F.count_if(kind == "click").alias("same"), F.count_if((kind == "view") & (F.col("value") > 80)).alias("other"), F.min(F.when(kind == "signup", F.col("value"))).alias("high"), F.collect_list(F.when(kind == "error", F.col("value"))).alias("low")
    ).withColumns({"other": F.when(F.col("user_id") % 3 > 0, F.col("other")), "rejected": F.when(F.col("user_id") % 7 == 0, 503)})
    return counters.select("user_id", guard.salt_verdict(F.col("same"), F.col("other"))["verdict"].alias("salt"), guard.priority_verdict(F.col("rejected"), F.col("high"), F.col("low"))["verdict"].alias("priority"))


@query("calc_scaled", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN round((o_totalprice * 1e5 - o_orderkey * 1e7) / (o_orderkey * 1e7) * 100, 6) END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'incompatible_units' END AS error_code,
       CASE o_orderkey % 6 WHEN 0 THEN 'The values are in different currencies.' WHEN 3 THEN 'The values are in different units.' END AS message FROM orders WHERE o_orderkey > 0""")
def _(t):
    """Growth from crores to lakhs, of the same or of other units."""
    k = F.col("o_orderkey")
    figure = lambda value, unit, scale: F.struct(value.cast("double").alias("value"), unit.alias("unit"), F.lit(scale).alias("scale"))
    other = F.when(k % 6 == 0, "USD").when(k % 6 == 3, "PCT").otherwise("INR")
    got = calc.of_figures(calc.growth, figure(k, F.lit("INR"), "crore"), figure(F.col("o_totalprice"), other, "Lakhs"))
    return t.orders.where("o_orderkey > 0").select("o_orderkey", got.alias("g")).select("o_orderkey", F.round("g.value", 6).alias("value"), "g.error_code", "g.message")


@query("canonical_rows", """
SELECT event_id, '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","id":' || event_id || ',"name":"\\u20b9 ' || event_type || ' \\ud83d\\ude00","none":null,"took":' || (user_id * 1000000 + 5) || '}' AS body FROM events""")
def _(t):
    rows = t.events.select("event_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat(F.lit("₹ "), "event_type", F.lit(" 😀")).alias("name"), F.lit(None).cast("string").alias("none"), F.expr("make_dt_interval(0, 0, 0, user_id + 0.000005)").alias("took"))
    return rows.select("event_id", sinks.canonical_row(rows, "id", "at", "name", "none", "took").alias("body"))
