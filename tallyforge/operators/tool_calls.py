"""Chat streams that bring tool calls in pieces: put together by index, checked against schemas, scored against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why an answer fails.
FAILURES = ("unparsed_tool_call", "no_call", "malformed_json", "unknown_tool", "schema", "unexpected_call", "wrong_tool", "wrong_args")
UNPARSED, NO_CALL, MALFORMED, UNKNOWN, SCHEMA, UNEXPECTED, WRONG_TOOL, WRONG_ARGS = FAILURES
CALLS = "array<struct<index: int, id: string, name: string, args: string>>"


def assemble(chunks: DataFrame, stream: str = "stream", seq: str = "seq") -> DataFrame:
    """chunks(stream, seq, content, index, id, name, args, finish) -> stream, body, calls, finish, interrupted.

    Contents follow each other by seq. Pieces of one index are one call: its last id that isn't empty, its names and arguments in
    order; calls stand by index. A stream that no chunk has finished is interrupted. Chunks may come twice: each seq counts once.
    """
    once = chunks.dropDuplicates([stream, seq, "index"])
    pieces = lambda c: F.expr(f"coalesce(listagg({c}, '') within group (order by `{seq}`), '')")
    given = F.when(F.col("id") != "", F.col("id"))
    by_index = once.where("index is not null").groupBy(stream, "index").agg(
        F.coalesce(F.max_by(given, F.when(given.isNotNull(), F.col(seq))), F.lit("")).alias("id"), pieces("name").alias("name"), pieces("args").alias("args")
    )
    calls = by_index.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), "id", "name", "args"))).alias("calls"))
    texts = once.dropDuplicates([stream, seq]).groupBy(stream).agg(pieces("content").alias("body"), F.max_by("finish", F.when(F.col("finish").isNotNull(), F.col(seq))).alias("finish"))
    out = texts.join(calls, stream, "left")
    return out.select(stream, "body", F.coalesce("calls", F.array().cast(CALLS)).alias("calls"), "finish", F.col("finish").isNull().alias("interrupted"))


def score(answers: DataFrame, schemas: dict[str, dict], expected: dict[str, dict]) -> DataFrame:
    """answers(case, name, args, content, ...) with valid, right_tool, right_args, failure, detail.

    name and args: of the first tool call, name null where there is none. expected: by case the tool (None: an answer without one) and
    matchers of its arguments. failure: one of FAILURES.
    """
    from ..functions import json_schema as js

    value = js.parsed(F.coalesce(F.nullif("args", F.lit("")), F.lit("{}")))
    errors = js.by_name(F.col("name"), {n: js.errors(s, value) for n, s in schemas.items()}, F.array().cast("array<string>"))
    wrong = js.by_name(F.col("case"), {c: _wrong(e.get("args", {}), value) for c, e in expected.items()}, F.array().cast("array<string>"))
    tool = js.by_name(F.col("case"), {c: F.lit(e["tool"]) if e["tool"] else F.lit(None).cast("string") for c, e in expected.items()}, F.lit(None).cast("string"))
    rows = answers.withColumns({"_errors": errors, "_wrong": wrong, "_tool": tool, "_parsed": value.isNotNull(), "_known": F.col("name").isin(*schemas)})
    none, left = F.col("name").isNull(), F.coalesce(F.col("content"), F.lit("")).rlike(r"<tool_call>|\"name\"\s*:\s*\"[^\"]*\"\s*,\s*\"arguments\"")
    broken = F.when(F.size("_errors") > 0, SCHEMA)
    failure = (
        F.when(none & left, UNPARSED).when(none & F.col("_tool").isNull(), F.lit(None)).when(none, NO_CALL)
        .when(~F.col("_parsed"), MALFORMED).when(~F.col("_known"), UNKNOWN)
        .when(F.col("_tool").isNull(), F.coalesce(broken, F.lit(UNEXPECTED))).when(F.col("name") != F.col("_tool"), F.coalesce(broken, F.lit(WRONG_TOOL)))
        .when(broken.isNotNull(), broken).when(F.size("_wrong") > 0, WRONG_ARGS)
    )
    silent = none & ~left
    valid = silent | (F.col("_parsed") & F.col("_known") & (F.size("_errors") == 0) & ~none)
    right_tool = (silent & F.col("_tool").isNull()) | F.coalesce(~none & F.col("_parsed") & F.col("_known") & (F.col("name") == F.col("_tool")), F.lit(False))
    detail = (
        F.when(F.col("failure").isin(UNEXPECTED, WRONG_TOOL, UNKNOWN), F.col("name")).when(F.col("failure") == SCHEMA, F.array_join(F.slice("_errors", 1, 3), "; "))
        .when(F.col("failure") == WRONG_ARGS, F.array_join(F.sort_array("_wrong"), ", ")).otherwise("")
    )
    done = rows.withColumns({"failure": failure, "valid": valid, "right_tool": right_tool})
    return done.withColumns({"right_args": F.col("failure").isNull() & F.col("right_tool"), "detail": detail}).drop("_errors", "_wrong", "_tool", "_parsed", "_known")


def _wrong(matchers: dict[str, dict], value: Column) -> Column:
    """Names of the arguments that don't match."""
    from ..functions import json_schema as js

    bad = [F.when(~js.matches(m, js.field(value, k)), F.lit(k)) for k, m in matchers.items()]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
