"""Streams with state by key, timers and a time to live.

They need the RocksDB state store: spark.sql.streaming.stateStore.providerClass, see ROCKSDB.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ZERO = datetime.datetime(1970, 1, 1)


def _ms(t: pd.Timestamp) -> int:
    return int((t.to_pydatetime() - _ZERO) / datetime.timedelta(milliseconds=1))


class _Locks(StatefulProcessor):
    """Attempts of a user wait until the watermark has passed them, so that they are judged in order; a timer opens the lock again."""

    def __init__(self, key: str, most: int, minutes: int):
        self.key, self.most, self.pause = key, most, minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "failures int, until bigint")
        self.waiting = handle.getListState("waiting", "at bigint, ok boolean")

    def _row(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=["at", "outcome", "failures", "until"])
            yield pd.DataFrame({self.key: key[0], "at": pd.to_datetime(out["at"], unit="ms"), "outcome": out["outcome"], "failures": out["failures"].astype("int32"), "locked_until": pd.to_datetime(out["until"], unit="ms")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, ok in zip(part["at"], part["ok"]):
                self.waiting.appendValue((_ms(at), bool(ok)))
                self.handle.registerTimer(_ms(at) + 1)
        yield from self._judged(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judged(key, timerValues.getCurrentWatermarkInMs())

    def _judged(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        failures, until = self.run.get() if self.run.exists() else (0, None)
        waiting = sorted(self.waiting.get())
        ready, out = [w for w in waiting if w[0] < watermark], []
        for at, ok in ready:
            if until is not None and until > at:
                out.append((at, "locked", failures, until))
                continue
            if until is not None:
                out.append((until, "opened", 0, None))
                failures, until = 0, None
            failures = 0 if ok else failures + 1
            if failures >= self.most:
                until = at + self.pause
                self.handle.registerTimer(until + 1)
            out.append((at, "ok" if ok else "failed", failures, until))
        if until is not None and until < watermark:
            out.append((until, "opened", 0, None))
            failures, until = 0, None
        if ready:
            self.waiting.put(waiting[len(ready) :]) if len(ready) < len(waiting) else self.waiting.clear()
        if failures:
            self.run.update((failures, until))
        else:
            self.run.clear()  # a user without a run of failures needs no state
        yield from self._row(key, out)

    def close(self) -> None:
        pass


def login_locks(attempts: DataFrame, user: str, at: str, ok: str, most: int = 5, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """The outcome of each attempt, and a row `opened` when a lock ends by event time, whether the user tries again or not.

    As operators.ordered.login_locks judges them: attempts may come in any order within `late`; what is later still is dropped.
    """
    kind = attempts.schema[user].dataType.simpleString()
    rows = attempts.select(F.col(user), F.col(at).cast("timestamp").alias("at"), F.col(ok).alias("ok")).withWatermark("at", late)
    return rows.groupBy(user).transformWithStateInPandas(
        statefulProcessor=_Locks(user, most, minutes), outputStructType=f"{user} {kind}, at timestamp, outcome string, failures int, locked_until timestamp", outputMode="Append", timeMode="EventTime"
    )


class _Calls(StatefulProcessor):
    """Pieces by index and seq, until the stream has finished and no seq is lacking, or until nothing has come for a while."""

    def __init__(self, key: str, patience: int):
        self.key, self.patience = key, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "seq bigint, index int", "content string, id string, name string, args string, finish string")
        self.end = handle.getValueState("end", "last bigint, timer bigint, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, timer, closed = self.end.get() if self.end.exists() else (None, None, False)
        latest = 0
        for part in rows:
            for r in part.itertuples(index=False):
                if closed:
                    continue
                text = lambda v: None if pd.isna(v) else v
                self.pieces.updateValue((int(r.seq), -1 if pd.isna(r.index_) else int(r.index_)), (text(r.content), text(r.id), text(r.name), text(r.args), text(r.finish)))
                last = int(r.seq) if text(r.finish) else last
                latest = max(latest, _ms(r.at))
        if closed:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(timer or 0, latest + self.patience)
        self.handle.registerTimer(timer)
        whole = last is not None and {k[0] for k in self.pieces.keys()} >= set(range(last + 1))
        self.end.update((last, timer, whole))
        if whole:
            yield self._out(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, closed = self.end.get() if self.end.exists() else (None, None, True)
        if not closed:
            yield self._out(key, last is None)
        self.pieces.clear()
        self.end.clear()  # until then a finished stream ignores pieces that come again

    def _out(self, key: tuple, interrupted: bool) -> pd.DataFrame:
        body, calls, finish = "", {}, None
        for (_, index), (content, id_, name, args, end) in sorted(self.pieces.iterator(), key=lambda p: p[0]):
            body, finish = body + (content or ""), end or finish
            if index >= 0:
                was = calls.get(index, ("", "", ""))
                calls[index] = (id_ or was[0], was[1] + (name or ""), was[2] + (args or ""))
        self.pieces.clear()
        listed = [{"index": i, "id": c[0], "name": c[1], "args": c[2]} for i, c in sorted(calls.items())]
        return pd.DataFrame({self.key: [key[0]], "body": [body], "calls": [listed], "finish": [finish], "interrupted": [interrupted]})

    def close(self) -> None:
        pass


def tool_calls(chunks: DataFrame, stream: str = "stream", late: str = "1 minute", patience: int = 60) -> DataFrame:
    """One row for each stream, as operators.tool_calls.assemble gives it: chunks(stream, seq from 0, at, content, index, id, name, args, finish).

    Pieces may come in any order and repeatedly. A stream is given out once it has finished and has all its pieces; so many seconds of
    event time after its last piece it is given out as it is, and its state goes.
    """
    kind = chunks.schema[stream].dataType.simpleString()
    rows = chunks.select(stream, "seq", F.col("at").cast("timestamp").alias("at"), "content", F.col("index").alias("index_"), "id", "name", "args", "finish").withWatermark("at", late)
    return rows.groupBy(stream).transformWithStateInPandas(
        statefulProcessor=_Calls(stream, patience * 1000),
        outputStructType=f"{stream} {kind}, body string, calls array<struct<index: int, id: string, name: string, args: string>>, finish string, interrupted boolean", outputMode="Append", timeMode="EventTime",
    )
