"""Folds over the rows of a key in order, one after another.

A key's rows are never gathered: they are sorted inside their partition and pass through a task in batches, with the state carried
from row to row. So a key may be longer than memory; its rows are still worked on by one task, as each needs its predecessor's state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], reads: Sequence[str], start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]], adds: str) -> DataFrame:
    """df with the columns `adds`: step(state, *values of `reads`) -> (next state, added values), from start() on for each key.

    Rows that tie in the order are taken in any order, so an order is to be whole where the result depends on it. Null keys are one key.
    """
    added = _parse_datatype_string(adds)
    schema = StructType([*df.schema.fields, *added.fields])
    names, arrow = df.columns, to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            mine = zip(*(batch.column(names.index(k)).to_pylist() for k in keys))
            values = zip(*(batch.column(names.index(c)).to_pylist() for c in reads))
            out = []
            for key, row in zip(mine, values):
                if key != last:
                    last, state = key, start()
                state, new = step(state, *row)
                out.append(new)
            columns = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *arrow.names])

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, schema)


def append_chain(df: DataFrame, chain: str, order: Sequence[str], body: Column) -> DataFrame:
    """Rows with seq, prev_hash and hash of their chain: each hash covers the one before it and the row's body (null: empty)."""
    import hashlib

    def link(state: tuple[int, str], text: str | None) -> tuple[tuple[int, str], tuple]:
        seq, before = state
        now = hashlib.sha256((before + (text or "")).encode()).hexdigest()
        return (seq + 1, now), (seq + 1, before, now)

    return fold(df.withColumn("_body", body), [chain], order, ["_body"], lambda: (0, ""), link, "seq int, prev_hash string, hash string").drop("_body")


def budget_choice(df: DataFrame, key: str, rank: Sequence[str], place: str, size: str, budget: int) -> DataFrame:
    """Rows of each key taken greedily in rank order while they fit the budget: what doesn't fit (or has no size) is skipped, not the end.

    Returned with `turn`, their order by place.
    """
    from pyspark.sql.window import Window

    def take(used: int, n: int | None) -> tuple[int, tuple]:
        fits = n is not None and used + n <= budget
        return used + n if fits else used, (fits,)

    chosen = fold(df, [key], rank, [size], int, take, "_taken boolean").where("_taken").drop("_taken")
    return chosen.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(place)))


def login_locks(attempts: DataFrame, user: str, at: str, ok: str, order: Sequence[str] = (), most: int = 5, minutes: int = 15) -> DataFrame:
    """Login attempts with outcome (ok, failed or locked), the run of failures and locked_until after them.

    So many failures in a row lock a user for so many minutes. While locked, attempts are refused and don't count, right ones too. A
    failure after the lock has ended starts a new run; a success ends it. Null times sort first and never meet a lock.
    """
    import datetime

    pause = datetime.timedelta(minutes=minutes)

    def attempt(state: tuple, when: datetime.datetime | None, good: bool | None) -> tuple[tuple, tuple]:
        failures, until = state
        if until is not None and when is not None and until > when:
            return state, ("locked", *state)
        if good:
            return (0, None), ("ok", 0, None)
        failures = 1 if until is not None else failures + 1
        state = failures, when + pause if failures >= most and when is not None else None
        return state, ("failed", *state)

    kind = attempts.schema[at].dataType.simpleString()
    return fold(attempts, [user], [at, *order], [at, ok], lambda: (0, None), attempt, f"outcome string, failures int, locked_until {kind}")


def packed(items: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """items with `pack`: in order, each goes into the pack of the one before it while the sizes fit the budget, else it opens the next.

    An item beyond the budget is a pack of its own. No size counts as none.
    """

    def put(state: tuple[int, int], n: int | None) -> tuple[tuple[int, int], tuple]:
        pack, used = state
        n = n or 0
        state = (pack, used + n) if pack and used + n <= budget else (pack + 1, n)
        return state, (state[0],)

    return fold(items, keys, order, [size], lambda: (0, 0), put, "pack int")
