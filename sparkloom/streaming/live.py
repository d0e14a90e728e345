"""Runs watched while they happen: each task's state kept from its events, and tasks that are stuck told by a timer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINAL = ("success", "failed", "skipped", "cached")
_STATE = "seq long, status string, attempts int, at long, events long, timer long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Tasks(StatefulProcessor):
    """The newest event of a task, how many there were, and the timer that is set (0: none)."""

    def __init__(self, final: Sequence[str], stuck: int, keep: int):
        self.final, self.stuck, self.keep = frozenset(final), stuck, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _told(self, key: tuple, state: tuple, stuck: bool) -> pd.DataFrame:
        seq, status, attempts, at, events, _ = state
        made = pd.DataFrame({"run_id": [key[0]], "task": [key[1]], "seq": [seq], "status": [status], "attempts": [attempts], "at": [at], "events": [events], "stuck": [stuck]})
        return made.astype({"attempts": "Int32"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        newest = None if before is None else tuple(before)
        events = 0 if before is None else before[4]
        for some in rows:
            events += int(some.events.sum())
            best = some.loc[some.seq.idxmax()]
            if newest is None or best.seq > newest[0]:
                newest = (int(best.seq), best.status, None if pd.isna(best.attempts) else int(best.attempts), int(best["at"]), 0, 0)
        if newest is None:
            return
        timer = before[5] if before is not None else 0
        if before is None or newest[0] > before[0]:
            if timer:
                self.handle.deleteTimer(timer)
            timer = newest[3] + (self.keep if newest[1] in self.final else self.stuck)
            self.handle.registerTimer(timer)
        state = (*newest[:4], events, timer)
        self.last.update(state)
        yield self._told(key, state, not timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.last.get()) if self.last.exists() else None
        if state is None or state[5] != expiredTimerInfo.getExpiryTimeInMs():
            return
        if state[1] in self.final:
            self.last.clear()
            return
        self.last.update((*state[:5], 0))
        yield self._told(key, state, True)

    def close(self) -> None:
        pass


def _newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each task in a batch the newest event, the latest time and how many there are: a task with most of all events sends few rows."""
    for rows in batches:
        rows = rows.reset_index(drop=True)
        grouped = rows.groupby(["run_id", "task"], dropna=False, sort=False)
        made = rows.loc[grouped.seq.idxmax().to_numpy()]
        yield made.assign(ts=grouped.ts.max().to_numpy(), events=grouped.size().to_numpy())


def watch(events: DataFrame, *, stuck: float = 3600, keep: float = 86_400, late: str = "10 minutes", final: Sequence[str] = FINAL) -> DataFrame:
    """A row for each change of a task: run_id, task, seq, status, attempts, at (milliseconds), events, stuck.

    ``events`` is a stream with run_id, task (both are told as text), seq, status, attempts and ts. The event with the greatest ``seq`` decides,
    in whatever order events arrive; of events with the same ``seq`` any one does, and each counts in ``events``. A task
    whose newest event isn't ``final`` is told once more, with ``stuck`` true, when the watermark (the latest time less
    ``late``) is more than ``stuck`` seconds past that event; its next event makes it false again. A task that has ended
    is forgotten ``keep`` seconds later; events that come after that begin anew. Of a task the row with the greatest
    (``seq``, ``events``, ``stuck``) is the last one: ``current`` picks it. Events without ``seq`` or ``ts`` have no part.

    For streams in update mode. State is kept by RocksDB, which is set for the session. Before the shuffle each Arrow
    batch is reduced to a row for each of its tasks.
    """
    events.sparkSession.conf.set(_PROVIDER, _ROCKS)
    own = events.where("seq IS NOT NULL AND ts IS NOT NULL").select(F.col("run_id").cast("string"), F.col("task").cast("string"), F.col("seq").cast("long"), "status", F.col("attempts").cast("int"), F.col("ts").cast("timestamp"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    schema = T.StructType([*own.schema.fields, T.StructField("events", T.LongType())])
    reduced = own.mapInPandas(_newest, schema).withWatermark("ts", late)
    told = T.StructType([*(own.schema[c] for c in ("run_id", "task", "seq", "status", "attempts", "at")), T.StructField("events", T.LongType()), T.StructField("stuck", T.BooleanType())])
    processor = _Tasks(final, int(stuck * 1000), int(keep * 1000))
    return reduced.groupBy("run_id", "task").transformWithStateInPandas(processor, told, "Update", "EventTime")


def current(changes: DataFrame) -> DataFrame:
    """The last row of each task, of all rows that ``watch`` has written: a max, combined before the shuffle."""
    rest = ["seq", "events", "stuck", "status", "attempts", "at"]
    newest = changes.groupBy("run_id", "task").agg(F.max(F.struct(*rest)).alias("e"))
    return newest.select("run_id", "task", *[f"e.{c}" for c in rest])
