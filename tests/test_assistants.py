"""Folds in order, locks, tool calls, schemas, known values, paragraphs and notes: against plain versions, in batch and as streams."""

from __future__ import annotations

import datetime
import hashlib
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import json_schema as js
from tallyforge.operators import known_values, notes, ordered, paragraphs, relational, tool_calls
from tallyforge.streaming import stateful

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


# -- chains


def test_chain_roots_of_a_long_chain_and_a_cycle(spark):
    rows = [(i, i - 1 if i else None) for i in range(5000)] + [(9001, 9002), (9002, 9003), (9003, 9001), (9004, 9001), (7000, 6999), (7001, 7000)]
    got = {r["id"]: (r["root"], r["depth"]) for r in relational.chain_roots(spark.createDataFrame(rows, "id int, up int"), "id", "up").collect()}
    assert got == {i: (0, i) for i in range(5000)} | {7000: (7000, 0), 7001: (7000, 1)}  # 6999 isn't there; the cycle is left out
    assert relational.chain_roots(spark.createDataFrame([(1, 1)], "id int, up int"), "id", "up").count() == 0


def test_one_long_audit_chain(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("chain"), F.col("id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("body"))
    got = ordered.append_chain(df.repartition(8), "chain", ["id"], F.col("body")).orderBy("seq").collect()
    before = ""
    for k, r in enumerate(got):
        now = hashlib.sha256((before + (r["body"] or "")).encode()).hexdigest()
        assert (r["seq"], r["id"], r["prev_hash"], r["hash"]) == (k + 1, k, before, now)
        before = now
    assert len(got) == n and ordered.append_chain(df.limit(0), "chain", ["id"], F.col("body")).count() == 0


def test_budget_choice_skips_what_has_no_size(spark):
    rows = [("x", 0, 50), ("x", 1, None), ("x", 2, 30), (None, 0, 85), (None, 1, 1)]
    got = ordered.budget_choice(spark.createDataFrame(rows, "doc string, place int, size int"), "doc", ["size"], "place", "size", 85).collect()
    assert sorted(((r["doc"], r["place"], r["turn"]) for r in got), key=repr) == sorted([("x", 0, 1), ("x", 2, 2), (None, 1, 1)], key=repr)


# -- locks


def plain_locks(attempts, most, minutes):
    """(user, at, ok) -> (user, at, outcome, failures, locked_until), one attempt after the other."""
    state, out = {}, []
    for user, when, ok in sorted(attempts, key=lambda a: (a[0], a[1])):
        failures, until = state.get(user, (0, None))
        if until and until > when:
            outcome = "locked"
        elif ok:
            outcome, failures, until = "ok", 0, None
        else:
            outcome, failures = "failed", 1 if until else failures + 1
            until = when + datetime.timedelta(minutes=minutes) if failures >= most else None
        state[user] = failures, until
        out.append((user, when, outcome, failures, until))
    return out


def attempts(seed, n=300):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(4)}", at(m * 2 + rng.random() / 2), rng.random() < 0.25) for m in range(n)]


def test_login_locks(spark):
    rows = attempts(3)
    df = spark.createDataFrame(rows, "user string, ts timestamp, ok boolean")
    got = [tuple(r) for r in ordered.login_locks(df, "user", "ts", "ok").select("user", "ts", "outcome", "failures", "locked_until").collect()]
    want = plain_locks(rows, 5, 15)
    assert sorted(got, key=repr) == sorted(want, key=repr) and {"locked", "ok", "failed"} == {w[2] for w in want}


@pytest.fixture
def stream(spark, tmp_path):
    """feed(rows) writes a file and runs the query on what is new; all that came out so far is returned."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)

    def make(schema, query):
        where = tmp_path / "in"
        where.mkdir()
        numbers = itertools.count()
        out = query(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(where)))

        def feed(rows):
            lines = [json.dumps({k: str(v) if isinstance(v, datetime.datetime) else v for k, v in r.items()}) for r in rows]
            (where / f"{next(numbers):03}.json").write_text("\n".join(lines))
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
            return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()

        return feed

    yield make
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_locks_in_a_stream_open_by_event_time(stream):
    feed = stream("user string, ts timestamp, ok boolean", lambda s: stateful.login_locks(s, "user", "ts", "ok", 3, 15, "5 minutes"))
    row = lambda u, m, ok: {"user": u, "ts": at(m), "ok": ok}
    feed([row("a", 3, False), row("a", 1, False), row("b", 1, True), row("a", 2, False)])  # out of order
    feed([row("a", 4, True), row("b", 12, False), row("a", 0.5, False)])
    got = feed([row("c", 60, False)])  # nobody tries again; the watermark alone opens the lock
    mine = [(r["at"], r["outcome"], r["failures"], r["locked_until"]) for r in got if r["user"] == "a"]
    assert sorted(mine, key=lambda r: (r[0], r[1])) == [
        (at(0.5), "failed", 1, None), (at(1), "failed", 2, None), (at(2), "failed", 3, at(17)), (at(3), "locked", 3, at(17)), (at(4), "locked", 3, at(17)), (at(17), "opened", 0, None)]
    got = feed([row("a", 70, False), row("z", 200, True)])
    assert ("a", at(70), "failed", 1, None) in [(r["user"], r["at"], r["outcome"], r["failures"], r["locked_until"]) for r in got]


def test_locks_in_a_stream_are_those_of_a_batch(stream):
    rows = attempts(5, 120)
    feed = stream("user string, ts timestamp, ok boolean", lambda s: stateful.login_locks(s, "user", "ts", "ok", 4, 15, "10 minutes"))
    for part in (rows[:60], rows[60:]):
        part = [{"user": u, "ts": t, "ok": ok} for u, t, ok in part]
        random.Random(1).shuffle(part)
        feed(part)
    got = feed([{"user": "end", "ts": at(5000), "ok": True}])
    judged = [(r["user"], r["at"], r["outcome"], r["failures"], r["locked_until"]) for r in got if r["outcome"] != "opened"]
    ms = lambda t: t and t.replace(microsecond=t.microsecond // 1000 * 1000)  # noqa: E731  (event time is in milliseconds)
    want = plain_locks([(u, ms(t), ok) for u, t, ok in rows], 4, 15)
    assert sorted(map(repr, judged)) == sorted(map(repr, want))


# -- tool calls

PIECES = [  # stream, seq, content, index, id, name, args, finish
    ("s", 0, "Let ", None, None, None, None, None), ("s", 1, "me", 0, "c1", "sum_", '{"a"', None), ("s", 2, None, 1, "c2", "get", "{", None), ("s", 3, None, 0, "", "up", ': 1}', None),
    ("s", 4, "!", 1, None, None, "}", None), ("s", 5, None, None, None, None, None, "tool_calls"), ("t", 0, "cut", 2, "x", "f", "(", None),
]
CALLS = {"s": ("Let me!", [(0, "c1", "sum_up", '{"a": 1}'), (1, "c2", "get", "{}")], "tool_calls", False), "t": ("cut", [(2, "x", "f", "(")], None, True)}
NAMES = ("stream", "seq", "content", "index", "id", "name", "args", "finish")


def test_tool_calls(spark):
    rows = PIECES + PIECES[2:4]  # some twice
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "stream string, seq bigint, content string, index int, id string, name string, args string, finish string")
    assert {r["stream"]: (r["body"], [tuple(c) for c in r["calls"]], r["finish"], r["interrupted"]) for r in tool_calls.assemble(df).collect()} == CALLS
    assert tool_calls.assemble(df.where("index is null and stream = 's'")).first()["calls"] == [] and tool_calls.assemble(df.limit(0)).count() == 0


def test_tool_calls_in_a_stream(stream):
    """Late pieces of several indices, one twice, and a stream that ends without a finish."""
    schema = "stream string, seq bigint, at timestamp, content string, index int, id string, name string, args string, finish string"
    feed = stream(schema, lambda s: stateful.tool_calls(s, patience=120))
    row = lambda k, m: dict(zip(NAMES, PIECES[k]), at=at(m))
    assert feed([row(5, 0.2), row(0, 0), row(4, 0.1), row(6, 0)]) == []  # finished, but pieces are missing
    got = feed([row(3, 0.3), row(2, 0.3), row(2, 0.3), row(1, 0.4)])
    assert [r["stream"] for r in got] == ["s"]
    got = feed([row(1, 0.5), {**row(0, 10), "stream": "u"}]) and feed([{**row(0, 60), "stream": "v"}])
    assert {r["stream"]: (r["body"], [tuple(c) for c in r["calls"]], r["finish"], r["interrupted"]) for r in got if r["stream"] in "st"} == CALLS
    assert [r["stream"] for r in got].count("s") == 1


# -- schemas and matchers


def plain_errors(schema, value, path="$"):
    kind = schema.get("type")
    real = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(value)]
    if kind and real != kind and not (kind == "number" and real == "integer"):
        return [f"{path}: not {'an' if kind[0] in 'aeio' else 'a'} {kind}"]
    if kind == "object":
        out = [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: not allowed" for k in sorted(value) if k not in schema["properties"]]
        return out + [e for k, s in schema.get("properties", {}).items() if k in value for e in plain_errors(s, value[k], f"{path}.{k}")]
    if kind == "array":
        out = [f"{path}: too few items"] * (len(value) < schema.get("minItems", 0)) + [f"{path}: too many items"] * (len(value) > schema.get("maxItems", 99))
        return out + [e for i, v in enumerate(value) for e in plain_errors(schema.get("items", {}), v, f"{path}[{i}]")]
    if kind == "string":
        if "enum" in schema and value not in schema["enum"]:
            return [f"{path}: not one of {schema['enum']}"]
        return [f"{path}: bad length"] * (not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 99))
    if kind in ("integer", "number"):
        if "minimum" in schema and value < schema["minimum"]:
            return [f"{path}: below minimum"]
        return [f"{path}: not above minimum"] * ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"])
    return []


SCHEMA = {
    "type": "object", "required": ["op", "keys"], "additionalProperties": False,
    "properties": {
        "op": {"type": "string", "enum": ["sum", "mean"]}, "n": {"type": "integer", "minimum": 1}, "ratio": {"type": "number", "exclusiveMinimum": 0}, "label": {"type": "string", "minLength": 2, "maxLength": 4}, "any": {},
        "keys": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string"}, "up": {"type": "array", "items": {"type": "number"}}}}},
    },
}
VALUES = [
    {"op": "sum", "keys": [{"k": "a", "up": [1, 2.5]}], "n": 3, "ratio": 0.5, "label": "abc", "any": None}, {"op": "max", "keys": [], "n": 0, "ratio": 0, "label": "a"}, {"keys": [{"k": 1}, {}, {"k": "x", "up": [True, "1"]}], "z": 1, "b": 2},
    {"op": None, "keys": {"k": 1}, "n": 2.0, "ratio": 1}, {"op": "mean", "keys": [3], "n": True, "label": "ééééé"}, [], "text", 5, None, {},
]


def test_schema_errors(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(90, "{broken"), (91, None)], "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", js.errors(SCHEMA, js.parsed(F.col("t"))).alias("e")).collect()}
    assert got.pop(90) == got.pop(91) == ["$: not an object"]
    assert got == {i: plain_errors(SCHEMA, v) for i, v in enumerate(VALUES)}


def plain_norm(v):
    if isinstance(v, str):
        text = v.strip().lower().replace(",", "")
        try:
            return float(text)
        except ValueError:
            return text
    return float(v) if isinstance(v, (int, float)) else json.dumps(v) if isinstance(v, (list, dict)) else v


def plain_match(matcher, v):
    inside = [plain_norm(x) for x in v] if isinstance(v, list) else None
    checks = {
        "equals": lambda e: plain_norm(v) == plain_norm(e), "one_of": lambda e: plain_norm(v) in [plain_norm(x) for x in e], "contains_any": lambda e: isinstance(v, str) and any(x.lower() in v.lower() for x in e),
        "range": lambda e: isinstance(v, (int, float)) and e[0] <= v <= e[1], "length": lambda e: isinstance(v, list) and len(v) == e, "present": lambda e: (v is not None) == e,
        "contains": lambda e: inside is not None and all(plain_norm(x) in inside for x in e),
        "items": lambda e: isinstance(v, list) and len(v) >= len(e) and all(plain_match(m, x.get(k) if isinstance(x, dict) else None) for s, x in zip(e, v) for k, m in s.items()),
    }
    return all(checks[k](e) for k, e in matcher.items())


MATCHERS = [
    {"equals": "1,200"}, {"equals": None}, {"equals": True}, {"equals": [1, "a"]}, {"one_of": ["A ", 3]}, {"contains_any": ["EB", "z"]}, {"range": [1, 3]}, {"length": 2}, {"present": True}, {"present": False}, {"contains": ["a", 1]},
    {"items": [{"k": {"equals": "x"}}, {"v": {"range": [0, 5]}}]}, {"present": True, "range": [2, 9], "one_of": [2, 3]}, {},
]
MATCHED = [1200, "1200", "1,200.0", "a", " A", "Web", 3, 2, 1.5, True, None, [1, "a"], ["A", "1", 2], [], [{"k": " X"}, {"v": 4}], [{"k": "x"}, {"v": 6}], [{"k": "x"}], [3, None], {"k": 1}]


def test_matchers(spark):
    df = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(MATCHED)] + [(99, "{}")], "i int, t string").withColumn("p", js.parsed(F.col("t")))
    got = {r["i"]: tuple(r)[1:] for r in df.select("i", *[js.matches(m, js.field(F.col("p"), "v")).alias(f"m{k}") for k, m in enumerate(MATCHERS)]).collect()}
    assert got == {i: tuple(plain_match(m, v) for m in MATCHERS) for i, v in [*enumerate(MATCHED), (99, None)]}
    with pytest.raises(ValueError):
        js.matches({"equal": 1}, F.col("p"))


def test_scores(spark):
    rows = [
        ("a", "sum", '{"op": "sum", "keys": [{"k": "x"}]}', None), ("a", "sum", '{"op": "mean", "keys": [{"k": "x"}]}', None), ("a", "sum", '{"op": "sum"}', None), ("a", "top", "{}", None), ("a", "top", '{"n": 0}', None), ("a", "nope", "{}", None),
        ("a", "sum", "{bad", None), ("a", None, None, "I can't"), ("a", None, None, '<tool_call>{"name": "sum"}'), ("b", None, None, "no tool"), ("b", "top", "", None), ("b", "sum", "{}", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, case string, name string, args string, content string")
    schemas = {"sum": {"type": "object", "required": ["op", "keys"]}, "top": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}}}
    expected = {"a": {"tool": "sum", "args": {"op": {"equals": "sum"}, "keys": {"length": 1}}}, "b": {"tool": None}}
    got = {r["i"]: (r["valid"], r["right_tool"], r["right_args"], r["failure"], r["detail"]) for r in tool_calls.score(df, schemas, expected).collect()}
    assert [got[i] for i in range(len(rows))] == [
        (True, True, True, None, ""), (True, True, False, "wrong_args", "op"), (False, True, False, "schema", "$.keys: missing"), (True, False, False, "wrong_tool", "top"), (False, False, False, "schema", "$.n: below minimum"),
        (False, False, False, "unknown_tool", "nope"), (False, False, False, "malformed_json", ""), (True, False, False, "no_call", ""), (False, False, False, "unparsed_tool_call", ""), (True, True, True, None, ""),
        (True, False, False, "unexpected_call", "top"), (False, False, False, "schema", "$.op: missing; $.keys: missing"),
    ]


# -- known values


def plain_mask(text, values):
    known = sorted({("".join(v.split()).lower(), w) for v, w in values if v and v.split()}, key=lambda v: (-len(v[0]), v))
    for k, (value, _) in enumerate(known):
        text = re.sub(r"\s*".join(map(re.escape, value)), chr(0xE000 + k), text, flags=re.IGNORECASE)
    return re.sub("[\ue000-\uf000]", lambda m: f"[{known[ord(m[0]) - 0xE000][1].upper()}]", text)  # labels aren't searched


@pytest.mark.parametrize("few", [known_values.FEW, -1])
def test_known_values(spark, monkeypatch, few):
    monkeypatch.setattr(known_values, "FEW", few)
    rng = random.Random(6)
    letters = "abcdXY01 \n"
    values = [("".join(rng.choice(letters) for _ in range(rng.choice((2, 3, 5, 7, 8, 9, 12, 20)))), rng.choice(("pan", "upi"))) for _ in range(80)] + [("4321 8765 1111", "aadhaar"), ("8765", "code"), ("a.b+c@x", "mail"), (" ", "none"), (None, "none"), ("éÉ-x", "name")]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    texts += ["no 43 2187 65\t1111, 8765", "A.B+C @X aab+c@x", "Éé-X ééé-xx", "", None, *(f"<{v}>{v}{w.upper()}" for v, w in values if v)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "id int, body string")
    given = spark.createDataFrame(values + values[:3], "value string, label string")
    got = {r["id"]: r["body"] for r in known_values.mask_known(df, "body", given).collect()}
    assert got == {i: t and plain_mask(t, values) for i, t in enumerate(texts)} | {texts.index(""): "", texts.index(None): None}
    assert known_values.mask_known(df, "body", given.limit(0)).count() == len(texts) + 1 and known_values.mask_known(df.limit(0), "body", given).count() == 0


# -- paragraphs, notes


def test_paragraphs(spark):
    rng = random.Random(4)
    paras, items, want = [], [], []
    for doc in range(12):
        lines = [rng.choice(("a", "b  c", "d", "")) for _ in range(rng.randrange(0, 40))]
        paras += [(doc, k, line) for k, line in enumerate(lines)]
        following, last = 0, 1
        for k in range(rng.randrange(0, 30)):
            line = rng.choice(("a", " b c", "d", "none", None))
            items.append((doc, k, line))
            plain = [" ".join(x.split()) for x in lines]
            at_ = next((i for i in range(following, len(lines)) if plain[i] == " ".join((line or "").split())), None)
            if at_ is not None:
                following = last = at_ + 1
            want.append((doc, k, last))
    shuffled = rng.sample(paras, len(paras)), rng.sample(items, len(items))
    a, b = (spark.createDataFrame(x, "doc int, ord int, line string") for x in shuffled)
    assert sorted((r["doc"], r["ord"], r["para"]) for r in paragraphs.locate(b, a, "doc", "ord", "line").collect()) == sorted(want)


def plain_tree(texts, budget, cut):
    """Packs of one level after the other, first fit in order."""
    level, made = [(t or "", [i]) for i, t in enumerate(texts)], 0
    while len(level) > 1:
        packs, used = [], 0
        for note in level:
            size = max(len(note[0]), 1)
            if packs and used + size <= budget:
                packs[-1].append(note)
                used += size
            else:
                packs.append([note])
                used = size
        if len(packs) == len(level):
            packs = [level[k : k + 2] for k in range(0, len(level), 2)]
        level = [(p[0][0] if len(p) == 1 else "|".join(t[:cut] for t, _ in p), [i for _, s in p for i in s]) for p in packs]
        made += 1
    return level[0]


def test_merge_tree(spark):
    rng = random.Random(7)
    texts = {k: ["".join(rng.choice("abc") for _ in range(rng.choice((0, 5, 20, 60, 300)))) for _ in range(n)] for k, n in (("x", 60), ("y", 1), ("z", 7), ("w", 150))}
    df = spark.createDataFrame([(k, i, t or None) for k, ts in texts.items() for i, t in enumerate(ts)], "k string, i int, t string")
    got = {r["k"]: (r["body"], r["sources"]) for r in notes.merge_tree(df, ["k"], ["i"], "t", "i", 100, lambda a: F.array_join(F.transform(a, lambda x: F.substring(x, 1, 12)), "|")).collect()}
    assert got == {k: plain_tree(ts, 100, 12) for k, ts in texts.items()}
    levels = {r["k"]: r["level"] for r in notes.merge_tree(df, ["k"], ["i"], "t", "i", 100, lambda a: F.array_join(F.transform(a, lambda x: F.substring(x, 1, 12)), "|")).collect()}
    assert levels["y"] == 0 and levels["w"] >= 3


# -- models and servers


def test_guard_outputs_and_verdicts(spark):
    from tallyforge.functions import guard

    texts = ["Safety: Unsafe\nCategories: Violent, PII , violent\nRefusal: YES", "safety:safe", " Safety: Controversial \n Categories: None\nRefusal: maybe", "Safety: fine", "", None, "x Safety: Safe", "Refusal: No\nSafety: Safe\nCategories:"]
    got = [tuple(r["g"]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(guard.guard_output(F.col("t")).alias("g")).collect()]
    bad = ("controversial", ["parse_error"], None)
    assert got == [("unsafe", ["PII", "Violent", "violent"], True), ("safe", [], None), ("controversial", [], None), bad, bad, bad, bad, ("safe", [], False)]
    replies = spark.createDataFrame([(0, []), (1, [("fine", None), (None, "")]), (2, [("a <think>", None)]), (3, [("a", "hm")]), (4, None)], "i int, r array<struct<content: string, reasoning: string>>")
    assert [r[0] for r in replies.orderBy("i").select(guard.thinking_verdict(F.col("r"))["verdict"]).collect()] == ["inconclusive", "pass", "fail", "fail", "inconclusive"]
    times = spark.createDataFrame([(0, None, 1.0, [3.0, 2.0, None]), (1, None, 1.3, [2.0, 3.0]), (2, 400, 0.1, [9.0]), (3, None, None, [1.0]), (4, None, 1.0, []), (5, None, 1.0, None)], "i int, rejected int, high double, low array<double>")
    verdicts = [r[0] for r in times.orderBy("i").select(guard.priority_verdict(F.col("rejected"), F.col("high"), F.col("low"))["verdict"]).collect()]
    assert verdicts == ["honoured", "ignored", "unsupported", "inconclusive", "inconclusive", "inconclusive"]


def test_schema_errors_read_each_value_once(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "integer", "minimum": 3}}}}, "c": {"type": "number"}}}
    df = spark.createDataFrame([('{"a": {"b": [1, 5, "x"]}, "c": "y"}',), ('{"a": 1}',), ("no",), (None,)], "t string").select(js.errors(schema, js.parsed(F.col("t"))).alias("e"))
    assert [r["e"] for r in df.collect()] == [["$.a.b[0]: below minimum", "$.a.b[2]: not an integer", "$.c: not a number"], ["$.a: not an object"], ["$: not an object"], ["$: not an object"]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("schema_of_variant") <= 6


def test_known_anchors_are_looked_up(spark, monkeypatch):
    import numpy as np

    known = np.array([-5, 2, 9], np.int64)
    assert known_values.among(np.array([-6, -5, 3, 9, 10]), known).tolist() == [False, True, False, True, False]
    assert known_values.among(np.array([1]), known[:0]).tolist() == [False]
    kept, real = [], known_values.written
    monkeypatch.setattr(known_values, "written", lambda df, name: kept.append(name) or real(df, name))
    texts = spark.createDataFrame([(1, "call a@b.cd now"), (2, None), (3, "")], "id int, text string")
    got = known_values.mask_known(texts, "text", spark.createDataFrame([("A@B.cd", "mail")], "value string, label string"))
    assert sorted((r["id"], r["text"]) for r in got.collect()) == [(1, "call [MAIL] now"), (2, None), (3, "")] and kept == ["values"]


def test_known_values_meet_texts_where_they_lie(spark, monkeypatch):
    """Texts aren't shuffled for values that fit a broadcast; more values meet only texts that have them, though they begin alike."""
    import numpy as np

    values = [f"4000 0000 0000 {i:04}" for i in range(300)]
    texts = spark.createDataFrame([(i, f"card {v}, paid") for i, v in enumerate(values)] + [(300, "4000 0000 0000 none"), (301, None)], "id int, text string")
    given = spark.createDataFrame([(v, "card") for v in values], "value string, label string")
    want = [(i, "card [CARD], paid") for i in range(300)] + [(300, "4000 0000 0000 none"), (301, None)]
    masked = known_values.mask_known(texts, "text", given)
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and sorted((r["id"], r["text"]) for r in masked.collect()) == want
    monkeypatch.setattr(known_values, "BYTES", 0)
    bare = [v.replace(" ", "") for v in values]
    known = known_values.Known(*(np.array(x, np.int64) for x in ([np.array(known_values.value_anchor(v), np.uint64).view(np.int64) for v in bare], [16] * 300, [known_values.value_hash(v) for v in bare])))
    assert len(set(known.anchor.tolist())) == 1 and all(known.within(f"card{v},paid").tolist() == [known_values.value_hash(v)] for v in bare)
    assert sorted((r["id"], r["text"]) for r in known_values.mask_known(texts, "text", given).collect()) == want
    test_known_values(spark, monkeypatch, known_values.FEW)
