"""Queries of calculation, text, figure, identifier and retrieval functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calc, figures, identifiers
from ..functions import text as tx
from ..operators import grounding, relational, retrieval, sheet
from ..sources import csv_text, events
from .base import query


def _money(c):
    return F.sum(sheet.money(c)).cast("double")


def _calc(name, function, value_sql, error_sql):
    @query(f"calc_{name}", f"""
WITH y AS (SELECT o_custkey AS k, sum(CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE AS a,
                  sum(CASE WHEN o_orderdate >= TIMESTAMP '1995-06-01' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE AS b FROM orders GROUP BY 1)
SELECT k, CASE WHEN {error_sql} IS NULL THEN round({value_sql}, 6) END AS value, {error_sql} AS error_code FROM y""")
    def _(t):
        early = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1995-06-01'")
        amount = sheet.money("o_totalprice")
        y = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.when(early, amount).otherwise(0)).cast("double").alias("a"), F.sum(F.when(~early, amount).otherwise(0)).cast("double").alias("b"))
        r = y.withColumn("r", function(F.col("a"), F.col("b")))
        return r.select("k", F.round("r.value", 6).alias("value"), "r.error_code")


ZERO_A, ZERO_B = "CASE WHEN a = 0 THEN 'zero_denominator' END", "CASE WHEN b = 0 THEN 'zero_denominator' END"
_calc("growth", calc.growth, "(b - a) / nullif(abs(a), 0) * 100", ZERO_A)
_calc("cagr", lambda a, b: calc.cagr(a, b, F.lit(3.0)), "CASE WHEN b = 0 THEN -100 ELSE (exp(ln(nullif(b, 0) / nullif(a, 0)) / 3.0) - 1) * 100 END", "CASE WHEN a <= 0 OR b < 0 THEN 'negative_base' END")
_calc("margin", calc.margin, "a / nullif(b, 0) * 100", ZERO_B)
_calc("ratio", calc.ratio, "a / nullif(b, 0)", ZERO_B)
_calc("multiple", calc.ratio, "a / nullif(b, 0)", ZERO_B)


@query("calc_sum", "SELECT c_mktsegment, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS value FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(_money("c_acctbal").alias("value"))


@query("calc_mean", "SELECT c_mktsegment, round(sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE / count(*), 4) AS value FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(F.round(_money("c_acctbal") / F.count(F.lit(1)), 4).alias("value"))


@query("calc_display", "SELECT c_custkey, CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) < 0 THEN '−' ELSE '' END || '₹' || format('{:,.2f}', abs(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE) || ' crore' AS shown FROM customer")
def _(t):
    return t.customer.select("c_custkey", calc.display(F.col("c_acctbal"), "INR", "crore").alias("shown"))


@query("calc_exact")
def _(t):
    by = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(sheet.money("o_totalprice").cast("string"))).alias("v"))
    return by.select("o_custkey", calc.exact(F.lit("mean"), "v", F.lit(None).cast("string")).alias("r")).select("o_custkey", "r.value", "r.error_code")


@query("calc_years", """
SELECT o_orderkey, CASE WHEN b > a AND (o_orderkey % 3 <> 0 OR b - a = 4) THEN b - a END AS years, CASE WHEN b <= a OR (o_orderkey % 3 = 0 AND b - a <> 4) THEN 'mismatched_periods' END AS error_code
FROM (SELECT o_orderkey, (2000 + o_orderkey % 7)::INT AS a, (2000 + o_orderkey % 11)::INT AS b FROM orders)""")
def _(t):
    label = lambda n: F.concat(F.lit("FY"), (F.col("o_orderkey") % n + 2000).cast("string"))
    r = calc.inferred_years(label(7), label(11), F.when(F.col("o_orderkey") % 3 == 0, 4))
    return t.orders.select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.value").alias("years"), "r.error_code")


@query("calc_formula", """
SELECT c_custkey, (CASE WHEN a < 0 THEN '(−' || format('{:,.2f}', -a) || ')' ELSE format('{:,.2f}', a) END) || ' ÷ 2,000.00 × 100 = x' AS shown FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE AS a FROM customer)""")
def _(t):
    return t.customer.select("c_custkey", calc.formula("margin", [calc.operand(F.col("c_acctbal"), 2), calc.operand(F.lit(2000), 2)], F.lit("x")).alias("shown"))


@query("cursor_round_trip", "SELECT o_orderkey, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(t):
    cursor = tx.encode_cursor(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey"))
    return t.orders.select("o_orderkey", tx.decode_cursor(cursor, "string", "bigint").alias("c")).select("o_orderkey", F.col("c._2").alias("id"), F.col("c._1").alias("day"))


@query("period_year", """
SELECT o_orderkey, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS year FROM (SELECT o_orderkey, try_cast(regexp_extract('FY' || (o_orderkey % 130), '^FY((?:19|20)\\d{2}|\\d{2})$', 1) AS INT) AS y FROM orders)""")
def _(t):
    label = F.concat(F.lit("FY"), (F.col("o_orderkey") % 130).cast("string"))
    return t.orders.select("o_orderkey", calc.label_year(label).alias("year"))


@query("parse_numeral", "SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18,2))::DOUBLE AS value, 2 AS decimals FROM orders")
def _(t):
    shown = F.format_number(sheet.money("o_totalprice"), 2)
    return t.orders.withColumn("p", tx.parse_numeral(shown)).select("o_orderkey", F.col("p.value").cast("double").alias("value"), "p.decimals")


@query("partial_date", "SELECT o_orderkey, (year(o_orderdate) * 10000 + month(o_orderdate) * 100)::INT AS code, 'M' AS precision, strftime(o_orderdate, '%Y-%m') AS iso FROM orders")
def _(t):
    code = tx.truncate_date(tx.encode_date(F.col("o_orderdate")), "M")
    return t.orders.withColumn("code", code).select("o_orderkey", "code", tx.date_precision(F.col("code")).alias("precision"), tx.date_iso(F.col("code")).alias("iso"))


@query("precision_match", "SELECT o_orderkey, abs(o_totalprice - round(o_totalprice, 0)) <= pow(10.0, -0) / 2 AS same, abs(o_totalprice - round(o_totalprice, 0)) <= pow(10.0, -1) / 2 AS close FROM orders")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", tx.precision_match(p, F.round(p, 0), F.lit(0)).alias("same"), tx.precision_match(p, F.round(p, 0), F.lit(1)).alias("close"))


@query("text_normalise", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def _(t):
    return t.part.select("p_partkey", tx.normalise_header(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("name"))


@query("a1_parse", "SELECT l_orderkey, l_partkey, 'S' || l_suppkey AS sheet, l_linenumber + 26 AS c0, l_linenumber AS r0, l_linenumber + 26 AS c1, (l_linenumber + 4) AS r1 FROM lineitem")
def _(t):
    column = F.concat(F.lit("A"), F.chr(F.col("l_linenumber") + 64))
    cell = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("!"), column, F.col("l_linenumber").cast("string"), F.lit(":"), column, (F.col("l_linenumber") + 4).cast("string"))
    return t.lineitem.withColumn("a", tx.a1_range(cell)).select("l_orderkey", "l_partkey", "a.*")


@query("format_ist", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y, %H:%M') AS shown FROM events")
def _(t):
    return t.events.select("event_id", F.date_format(F.expr("ts + INTERVAL 330 MINUTES"), "dd MMM yyyy, HH:mm").alias("shown"))


@query("format_indian")
def _(t):
    return t.orders.select("o_orderkey", tx.indian_grouping(F.col("o_totalprice").cast("bigint")).alias("shown"))


@query("fiscal_month", "SELECT o_orderkey, ((month(o_orderdate) + 8) % 12)::INT AS m FROM orders")
def _(t):
    return t.orders.select("o_orderkey", tx.fiscal_month(F.col("o_orderdate")).cast("int").alias("m"))


@query("parse_kv", "SELECT event_id, regexp_extract(line, 'Safety:\\s*(\\w+)', 1) AS safety, regexp_extract(line, 'Refusal:\\s*(\\w+)', 1) AS refusal FROM (SELECT event_id, 'Safety: ' || event_type || chr(10) || 'Refusal: ' || CASE WHEN value > 50 THEN 'Yes' ELSE 'No' END AS line FROM events)")
def _(t):
    line = F.concat(F.lit("Safety: "), "event_type", F.lit("\nRefusal: "), F.when(F.col("value") > 50, "Yes").otherwise("No"))
    return t.events.select("event_id", F.regexp_extract(line, r"Safety:\s*(\w+)", 1).alias("safety"), F.regexp_extract(line, r"Refusal:\s*(\w+)", 1).alias("refusal"))


@query("luhn", """
SELECT o_orderkey, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN d[i]::INT ELSE (d[i]::INT * 2) % 10 + (d[i]::INT * 2) // 10 END)) % 10 = 0 AS valid
FROM (SELECT o_orderkey, (4000000000000000 + o_orderkey * 7919)::VARCHAR AS d FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", tx.luhn_valid((F.lit(4000000000000000) + F.col("o_orderkey") * 7919).cast("string")).alias("valid"))


@query("mask_simple", "SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+', '[EMAIL]', 'g'), '\\b[0-9]{10,16}\\b', '[NUMBER]', 'g') AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.mask(tx.mask(F.col("text"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "EMAIL"), r"\b[0-9]{10,16}\b", "NUMBER").alias("text"))


@query("detect_simple", "SELECT doc_id, len(regexp_extract_all(text, '[A-Z]{5}[0-9]{4}[A-Z]')) AS pans, len(regexp_extract_all(text, '[0-9]{16}')) AS cards FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[A-Z]{5}[0-9]{4}[A-Z]")).cast("bigint").alias("pans"), F.regexp_count("text", F.lit("[0-9]{16}")).cast("bigint").alias("cards"))


@query("detect_identifiers")
def _(t):
    found = t.documents.select("doc_id", F.explode(identifiers.detect(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.*")


@query("mask_identifiers")
def _(t):
    return t.documents.select("doc_id", identifiers.mask(F.col("text")).alias("text"))


@query("extract_figures")
def _(t):
    return t.documents.select("doc_id", F.explode(figures.figures(F.col("text"))).alias("f")).select("doc_id", "f.*")


_CASES = """
SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN 'pan: ABCDE' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || 'F, signed' WHEN 1 THEN 'voter id ABC' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0')
  WHEN 2 THEN 'paid by user' || o_orderkey || '@ybl today' WHEN 3 THEN 'order ' || o_orderkey WHEN 4 THEN 'NSE: ABCDE' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || 'F'
  ELSE 'a/c 50' || lpad(o_orderkey::VARCHAR, 10, '0') || ' of the bank' END AS text FROM orders"""


def _identifier_texts(t):
    key, digits = F.col("o_orderkey"), lambda n: F.lpad((F.col("o_orderkey") % 10**n).cast("string"), n, "0")
    texts = [
        F.concat(F.lit("pan: ABCDE"), digits(4), F.lit("F, signed")), F.concat(F.lit("voter id ABC"), digits(7)), F.concat(F.lit("paid by user"), key.cast("string"), F.lit("@ybl today")),
        F.concat(F.lit("order "), key.cast("string")), F.concat(F.lit("NSE: ABCDE"), digits(4), F.lit("F")), F.concat(F.lit("a/c 50"), digits(10), F.lit(" of the bank")),
    ]
    return t.orders.select("o_orderkey", F.get(F.array(*texts), (key % 6).cast("int")).alias("text"))


@query("identifier_findings", f"""
SELECT o_orderkey, type, start, length(text) - after AS "end", score FROM (SELECT *, o_orderkey % 6 AS k FROM ({_CASES})) JOIN (VALUES
  (0, 'PAN', 5, 8, 1.0), (1, 'VOTER_ID', 9, 0, 0.7), (2, 'UPI_ID', 8, 6, 0.85), (5, 'BANK_ACCOUNT', 4, 12, 0.7)) v(k, type, start, after, score) USING (k)""")
def _(t):
    return _identifier_texts(t).select("o_orderkey", F.explode(identifiers.detect(F.col("text"))).alias("f")).select("o_orderkey", "f.*")


@query("identifier_masking", f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'pan: [PAN], signed' WHEN 1 THEN 'voter id [VOTER_ID]' WHEN 2 THEN 'paid by [UPI_ID] today' WHEN 5 THEN 'a/c [BANK_ACCOUNT] of the bank' ELSE text END AS text FROM ({_CASES})""")
def _(t):
    return _identifier_texts(t).select("o_orderkey", identifiers.mask(F.col("text")).alias("text"))


@query("figure_findings", """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 900 + 100 AS n, o_orderkey % 60 + 20 AS y FROM orders)
SELECT k, kind, unit, raw, value FROM (
  SELECT k, 'number' AS kind, 'INR' AS unit, '₹' || n || '.5 crore' AS raw, (n + 0.5) * 1e7 AS value FROM o UNION ALL SELECT k, 'period', 'DATE', 'FY' || y, (2000 + y) * 1e4 FROM o
  UNION ALL SELECT k, 'number', 'PCT', '-' || n || '%', -n::DOUBLE FROM o UNION ALL SELECT k, 'locator', 'PLAIN', 'pages ' || n || '-' || (n + 2), n::DOUBLE FROM o)""")
def _(t):
    n, y = (F.col("o_orderkey") % 900 + 100), (F.col("o_orderkey") % 60 + 20).cast("string")
    text = F.concat(F.lit("Sales of ₹"), n.cast("string"), F.lit(".5 crore in FY"), y, F.lit(" grew by -"), n.cast("string"), F.lit("%, see pages "), n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit("."))
    found = t.orders.select(F.col("o_orderkey").alias("k"), F.explode(figures.figures(text)).alias("f"))
    return found.select("k", "f.kind", "f.unit", "f.raw", F.col("f.value").cast("double").alias("value"))


@query("grounding_texts", """
WITH o AS (SELECT o_orderkey AS id, 100 + o_orderkey % 800 AS n FROM orders)
SELECT id, raw, reason FROM (
  SELECT id, '₹' || n || ' cr' AS raw, CASE id % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'cross_currency' ELSE 'not_found' END AS reason FROM o
  UNION ALL SELECT id, n || ' bps', 'matched' FROM o UNION ALL SELECT id, 'page ' || n, 'exempt' FROM o)""")
def _(t):
    n = (F.col("o_orderkey") % 800 + 100).cast("string")
    answer = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("It was ₹"), n, F.lit(" cr, up "), n, F.lit(" bps (page "), n, F.lit(")")).alias("text"))
    amount = F.concat(F.when(F.col("o_orderkey") % 3 == 1, "$").otherwise("₹"), n, F.when(F.col("o_orderkey") % 3 == 2, ".6 crore").otherwise(".4 crore"))
    source = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(amount, F.lit(" and "), F.round((F.col("o_orderkey") % 800 + 100) / 100, 2).cast("decimal(10,2)").cast("string"), F.lit("%")).alias("text"))
    return grounding.verdicts(answer, source).select("id", "raw", "reason")


@query("grounding_contexts", """
WITH o AS (SELECT o_orderkey AS id, (1990 + o_orderkey % 40)::VARCHAR AS y, (100 + o_orderkey % 800)::VARCHAR AS n FROM orders)
SELECT id, raw, reason FROM (
  SELECT id, y AS raw, 'exempt' AS reason FROM o UNION ALL SELECT id, y, 'exempt' FROM o UNION ALL SELECT id, n, 'exempt' FROM o
  UNION ALL SELECT id, y, 'not_found' FROM o UNION ALL SELECT id, n, CASE WHEN id % 2 = 0 THEN 'matched' ELSE 'not_found' END FROM o)""")
def _(t):
    """Years of a period phrase, before and behind it, and what a link to a source holds need no source; the same figures elsewhere do."""
    y, n = (F.col("o_orderkey") % 40 + 1990).cast("string"), (F.col("o_orderkey") % 800 + 100).cast("string")
    text = F.concat(F.lit("In Fiscal Year: "), y, F.lit(" we had "), n, F.lit(" deals, ["), n, F.lit(" of them](cite:doc) until "), y, F.lit(" was over; see "), y, F.lit(" financial year."))
    answer = t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text"))
    source = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("There were "), n, F.lit(" deals.")).alias("text"))
    return grounding.verdicts(answer, source).select("id", "raw", "reason")


_WORTH = "CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 ELSE ascii({c}) - 55 END"


@query("check_characters", f"""
WITH o AS (SELECT o_orderkey AS k, lpad((o_orderkey % 37 + 1)::VARCHAR, 2, '0') || 'ABCDE' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || 'F1Z' AS g, 'IN' || lpad(o_orderkey::VARCHAR, 9, '0') AS i FROM orders),
c AS (SELECT k, g, i, list_sum([(({_WORTH.format(c='g[p]')}) * (2 - p % 2)) // 36 + (({_WORTH.format(c='g[p]')}) * (2 - p % 2)) % 36 FOR p IN range(1, 15)]) AS s,
             reverse(array_to_string([({_WORTH.format(c='i[p]')})::VARCHAR FOR p IN range(1, 12)], '')) AS d FROM o)
SELECT k, (36 - s % 36) % 36 = k % 36 AS gstin, (10 - list_sum([CASE WHEN p % 2 = 0 THEN d[p]::INT WHEN d[p]::INT > 4 THEN d[p]::INT * 2 - 9 ELSE d[p]::INT * 2 END FOR p IN range(1, length(d) + 1)]) % 10) % 10 = k % 10 AS isin FROM c""")
def _(t):
    """Numbers made of order keys, with a check character that is right now and then."""
    k = F.col("o_orderkey")
    last = F.substring(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k % 36 + 1).cast("int"), F.lit(1))
    gstin = F.concat(F.lpad((k % 37 + 1).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z"), last)
    isin = F.concat(F.lit("IN"), F.lpad(k.cast("string"), 9, "0"), (k % 10).cast("string"))
    return t.orders.select(k.alias("k"), tx.gstin_valid(gstin).alias("gstin"), tx.isin_valid(isin).alias("isin"))


@query("extract_amounts_simple", "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS amount FROM documents")
def _(t):
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("amount"))


@query("exempt_flags", "SELECT o_orderkey, o_orderkey % 40 BETWEEN 0 AND 12 AS exempt FROM orders")
def _(t):
    f = F.struct(F.lit("number").alias("kind"), F.lit("COUNT").alias("unit"), (F.col("o_orderkey") % 40).cast("decimal(38,10)").alias("value"))
    return t.orders.select("o_orderkey", figures.is_exempt(f).alias("exempt"))


@query("grounding_match", """
WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'INR' ELSE 'USD' END AS unit, round(o_totalprice, -2) AS v FROM orders),
s AS (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'INR' ELSE 'USD' END AS unit, round(l_extendedprice, 0) AS key FROM lineitem)
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.unit = f.unit AND s.key >= f.v - 50 AND s.key < f.v + 50) THEN 'matched'
  WHEN EXISTS (SELECT 1 FROM s WHERE s.unit <> f.unit AND s.key >= f.v - 50 AND s.key < f.v + 50) THEN 'cross_currency' ELSE 'not_found' END AS reason FROM f""")
def _(t):
    figure = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "INR").otherwise("USD").alias("unit"), F.round("o_totalprice", -2).alias("v"))
    source = t.lineitem.select(F.when(F.col("l_orderkey") % 3 == 0, "INR").otherwise("USD").alias("unit"), F.round("l_extendedprice", 0).alias("key")).distinct()
    values = source.select(figures.dimension(F.col("unit")).alias("dim"), "key")
    other = F.when(F.col("unit") == "INR", "USD").otherwise("INR")
    asked = figure.select("id", (F.col("v") - 50).alias("lo"), (F.col("v") + 50).alias("hi"), F.explode(F.array(F.struct(F.lit(0).alias("rank"), figures.dimension(F.col("unit")).alias("dim")), F.struct(F.lit(1).alias("rank"), figures.dimension(other).alias("dim")))).alias("d"))
    hits = relational.range_join(values, asked.select("id", "lo", "hi", "d.*")).groupBy("id").agg(F.min("rank").alias("rank"))
    return figure.join(hits, "id", "left").select("id", F.when(F.col("rank") == 0, "matched").when(F.col("rank") == 1, "cross_currency").otherwise("not_found").alias("reason"))


@query("cosine_topk", """
SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score
FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, id LIMIT 10""")
def _(t):
    return retrieval.cosine_topk(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), t.embeddings.where("vec_id = 0"), 10)


@query("rrf", """
WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM embeddings QUALIFY rank <= 50),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50)
SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), (-F.col("label")).alias("up"), F.col("label").alias("down"))
    return retrieval.rank_fusion(retrieval.ranked(rows, "id", "up", 50).select("id", "rank").unionAll(retrieval.ranked(rows, "id", "down", 50).select("id", "rank")))


@query("chunk_text", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, i::INT AS chunk, array_to_string(w[i * 200 + 1:i * 200 + 200], ' ') AS body FROM (SELECT doc_id, w, unnest(range((len(w) + 199) // 200)) AS i FROM w)""")
def _(t):
    return retrieval.chunks(t.documents, "doc_id", "text", 200)


@query("flag_phrases", "SELECT doc_id, regexp_matches(lower(text), 'ignore (all|previous) instructions|https?://|password=') AS flagged FROM documents")
def _(t):
    return t.documents.select("doc_id", F.lower("text").rlike(r"ignore (all|previous) instructions|https?://|password=").alias("flagged"))


@query("scan_csv_text", "SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def _(t):
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")))
    return csv_text.parse_lines(t.customer.select(line.alias("line")), "line", ["id", "name", "segment"])


@query("sse_lines", "SELECT event_id, event_type AS name, '{\"v\":' || event_id || '}' AS data FROM events")
def _(t):
    raw = F.concat(F.lit("event: "), "event_type", F.lit("\n: comment\ndata: {\"v\":\n"), F.lit("data: "), F.col("event_id").cast("string"), F.lit("}\n\n"))
    parsed = events.parse_sse(t.events.select("event_id", raw.alias("raw")), "event_id", "raw")
    return parsed.select("event_id", "name", F.replace("data", F.lit("\n"), F.lit("")).alias("data"))


@query("metric_sum", "SELECT 'requests' AS name, sum(event_id)::DOUBLE AS value FROM events WHERE event_type = 'click'")
def _(t):
    line = F.concat(F.lit('requests{type="'), "event_type", F.lit('",user="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("event_id").cast("string"))
    return events.metric_sum(events.parse_metrics(t.events.select(line.alias("line")), "line"), "requests", {"type": "click"})


@query("markdown_table", "SELECT s_suppkey, s_name AS c1, s_nationkey::VARCHAR AS c2 FROM supplier")
def _(t):
    md = F.concat(F.lit("| Name | Nation |\n|---|---|\n| "), "s_name", F.lit(" | "), F.col("s_nationkey").cast("string"), F.lit(" |"))
    return events.parse_markdown_rows(t.supplier.select("s_suppkey", md.alias("md")), "s_suppkey", "md").select("s_suppkey", F.get("cells", F.lit(0)).alias("c1"), F.get("cells", F.lit(1)).alias("c2"))
