"""Structured Streaming forms of the time-bucketed and stateful operators.

The first three have a batch twin among the queries. Watermarks and late rows go beyond the reference operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit(events: DataFrame, key: str, window: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Events per key and fixed window, and whether they stay within the limit."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n", (F.col("n") <= limit).alias("allowed"))


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
    )


def fold_turns(rows: DataFrame, key: str, order: str, action: str, text: str) -> DataFrame:
    """Text of a turn so far: 'delta' appends, 'replace' starts again, 'done' ends it. One row per key and batch."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        body, done = state.get if state.exists else ("", False)
        for row in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            what, piece = getattr(row, action), getattr(row, text) or ""
            body, done = (piece if what == "replace" else body + piece if what == "delta" else body), done or what == "done"
        state.update((body, done))
        yield pd.DataFrame({key: [k[0]], "body": [body], "done": [done]})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, body string, done boolean", "body string, done boolean", "update", GroupStateTimeout.NoTimeout)


def lockouts(logins: DataFrame, key: str, order: str, ok: str, most: int = 5) -> DataFrame:
    """Consecutive failures per key, and whether they lock it; a success starts anew."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for good in pd.concat(list(batches)).sort_values(order)[ok]:
            failures = 0 if good else failures + 1
        state.update((failures,))
        yield pd.DataFrame({key: [k[0]], "failures": [failures], "locked": [failures >= most]})

    kind = dict(logins.dtypes)[key]
    return logins.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, failures int, locked boolean", "failures int", "update", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Everything that has arrived, then stop: the form a scheduler calls."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
