"""What models and their servers say, judged: guard outputs, and whether features of a server work, from counters and timings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdicts.
HONOURED, IGNORED, UNSUPPORTED, INCONCLUSIVE, PASS, FAIL = "honoured", "ignored", "unsupported", "inconclusive", "pass", "fail"
PARSE_ERROR = "parse_error"


def _line(text: Column, name: str, value: str) -> Column:
    """The value of the first line `name: value`, whatever the case; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^\s*{name}:[ \t]*({value})[ \t]*$"), F.lit(1))
    return F.get(found, F.lit(0))


def guard_output(text: Column) -> Column:
    """struct(safety, categories, refusal): safe, unsafe or controversial; categories sorted, without none; refusal null if it isn't said.

    What can't be read is controversial, with the category parse_error.
    """
    said = F.coalesce(text, F.lit(""))
    safety, listed = F.lower(_line(said, "safety", "safe|unsafe|controversial")), _line(said, "categories", r"[^\n]*?")
    names = F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda c: F.trim(c)), lambda c: (c != "") & (F.lower(c) != "none"))
    categories = F.when(safety.isNull(), F.array(F.lit(PARSE_ERROR))).otherwise(F.array_sort(F.array_distinct(names)))
    refusal = F.when(safety.isNotNull(), F.lower(_line(said, "refusal", "yes|no")) == "yes")
    return F.struct(F.coalesce(safety, F.lit("controversial")).alias("safety"), categories.alias("categories"), refusal.alias("refusal"))


def _verdict(*cases: tuple[Column | None, str, str | Column]) -> Column:
    """struct(verdict, why) of the first case that holds; the last one has no condition."""
    verdict = why = None
    for condition, name, reason in cases[:-1]:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        verdict = F.when(condition, name) if verdict is None else verdict.when(condition, name)
        why = F.when(condition, reason) if why is None else why.when(condition, reason)
    return F.struct(verdict.otherwise(cases[-1][1]).alias("verdict"), why.otherwise(cases[-1][2]).alias("why"))


def salt_verdict(same: Column, other: Column) -> Column:
    """Whether a cache keeps salts apart: its hits when a request is repeated with the same salt and with another."""
    return _verdict(
        (same.isNull() | other.isNull(), INCONCLUSIVE, "a counter is missing"), (same <= 0, INCONCLUSIVE, "no hits under one salt either"),
        (other > 0, IGNORED, "hits under another salt too"), (None, HONOURED, "hits under one salt alone"),
    )


def priority_verdict(rejected: Column, high: Column, low: Column, factor: float = 0.5) -> Column:
    """Whether a request of high priority overtakes: its first token within a part of the median (low: array) of those queued before it."""
    sorted_ = F.array_sort(F.filter(low, lambda x: x.isNotNull()))
    n = F.size(sorted_)
    middle = (F.get(sorted_, ((n - 1) / 2).cast("int")) + F.get(sorted_, (n / 2).cast("int"))) / 2
    return _verdict(
        (rejected.isNotNull(), UNSUPPORTED, F.concat(F.lit("refused with status "), rejected.cast("string"))), (high.isNull() | F.coalesce(n <= 0, F.lit(True)), INCONCLUSIVE, "no times to compare"),
        (high < middle * factor, HONOURED, "it overtook those that waited"), (None, IGNORED, "it waited as long as others"),
    )


def thinking_verdict(replies: Column) -> Column:
    """replies: array of struct(content, reasoning). Fails if any shows its thinking."""
    leaks = F.exists(replies, lambda m: F.coalesce(F.contains(m["content"], F.lit("<think>")), F.lit(False)) | (F.coalesce(m["reasoning"], F.lit("")) != ""))
    return _verdict((F.coalesce(F.size(replies) <= 0, F.lit(True)), INCONCLUSIVE, "no replies"), (leaks, FAIL, "a reply shows its thinking"), (None, PASS, "no reply shows its thinking"))
