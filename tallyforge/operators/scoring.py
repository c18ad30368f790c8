"""Scoring of results: table comparison, pass rates, gates, latency summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_stats(results: DataFrame, category: str, status: str) -> DataFrame:
    """Counts by status and the share passed of those scored; null where nothing was scored."""
    count = lambda s: F.count_if(F.col(status) == s)
    return results.groupBy(category).agg(
        F.count(F.lit(1)).alias("cases"), count("passed").alias("passed"), count("failed").alias("failed"), count("skipped").alias("skipped"),
        F.round(F.try_divide(count("passed").cast("double"), (count("passed") + count("failed")).cast("double")), 4).alias("pass_rate"),
    )


def gates(measures: DataFrame, bounds: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row of measures to a row per gate: name, value, verdict (pass, fail or n/a). bounds: name -> ('min'|'max', limit)."""
    rows = [
        F.struct(
            F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"),
            F.when(F.col(name).isNull(), "n/a").when((F.col(name) >= limit) if kind == "min" else (F.col(name) <= limit), "pass").otherwise("fail").alias("verdict"),
        )
        for name, (kind, limit) in bounds.items()
    ]
    return measures.select(F.inline(F.array(*rows)))


def percentiles(df: DataFrame, keys: Sequence[str], column: str, points: Sequence[float]) -> DataFrame:
    """Exact percentiles by linear interpolation."""
    return df.groupBy(*keys).agg(*[F.round(F.percentile(column, p), 4).alias(f"p{round(p * 100)}") for p in points])


def per_minute(count: Column, seconds: Column) -> Column:
    return F.try_divide(count * 60.0, seconds.cast("double"))


def table_compare(expected: DataFrame, actual: DataFrame, keys: Sequence[str], decimals: Mapping[str, int]) -> DataFrame:
    """Rows whose cells differ: keyed by the non-numeric columns, numbers equal within half of the last decimal shown."""
    a = expected.select(*keys, *[F.col(c).alias(f"e_{c}") for c in decimals], F.lit(True).alias("_e"))
    b = actual.select(*keys, *[F.col(c).alias(f"a_{c}") for c in decimals], F.lit(True).alias("_a"))
    same = F.lit(True)
    for c, d in decimals.items():
        same = same & F.coalesce(F.abs(F.col(f"e_{c}") - F.col(f"a_{c}")) <= 0.5 * 10.0**-d, F.col(f"e_{c}").isNull() & F.col(f"a_{c}").isNull())
    problem = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").when(~same, "different")
    return a.join(b, list(keys), "full").withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem")
