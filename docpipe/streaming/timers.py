"""Streams that act when nothing more comes: stability given up by a timer, debounce that closes its last run.

Both keep a small state for each key in the state store (RocksDB) and set timers of processing time, so a silent path or
profile is dealt with in the next micro-batch after its time, without a further event of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docpipe.streaming.events import FORGET_MS, MOST, REPEATS

#: Time without an observation after which a path that was not stable is given up: MOST observations, a second each.
GIVE_UP_MS = MOST * 1000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """Timers need the RocksDB state store; a setting of the session, read when a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def reset_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The key's only timer."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t if isinstance(t, int) else t[0])
    if at is not None:
        handle.registerTimer(at)


class Watch(StatefulProcessor):
    """What was last seen of a path, how often it repeated and how often it was observed."""

    def __init__(self, timed: bool, give_up_ms: int, forget_ms: int):
        self.timed, self.give_up_ms, self.forget_ms = timed, give_up_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, changed long, run int, n int, done boolean", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, changed, run, n, done = self.seen.get() if self.seen.exists() else (None, None, 0, 0, False)
        for row in pd.concat(list(rows)).sort_values(["ts", "size"]).itertuples(index=False):
            size, at = int(row.size), (row.modified.value if self.timed and row.modified is not pd.NaT else None)
            same = n > 0 and (size, at) == (last, changed)
            if done and same:
                continue
            if done:
                n, run, done = 0, 0, False
            n, run = n + 1, run + 1 if same else 0
            last, changed = size, at
            if run >= REPEATS or n >= MOST:
                done = True
                yield pd.DataFrame({"path": [key[0]], "ts": [row.ts if run >= REPEATS else pd.NaT], "size": [last], "stable": [run >= REPEATS]})
        self.seen.update((last, changed, run, n, done))
        reset_timer(self.handle, None if done else timerValues.getCurrentProcessingTimeInMs() + self.give_up_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and not (x := self.seen.get())[4]:
            self.seen.update((x[0], x[1], x[2], x[3], True))
            yield pd.DataFrame({"path": [key[0]], "ts": [pd.NaT], "size": [x[0]], "stable": [False]})

    def close(self) -> None:
        pass


def watched_stream(seen: DataFrame, give_up_ms: int = GIVE_UP_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """As `events.stable_stream`, and a path that is no longer observed is given up give_up_ms after its last observation.

    A path that was stable or given up is watched anew once its signature changes; forget_ms after its last change of
    state the store drops it.
    """
    use_store(seen.sparkSession)
    return seen.groupBy("path").transformWithStateInPandas(Watch("modified" in seen.columns, give_up_ms, forget_ms), "path string, ts timestamp, size long, stable boolean", "append", "ProcessingTime")


class Debounce(StatefulProcessor):
    """The open run of a profile's changes: its first and last time, and how many."""

    def __init__(self, gap_ms: int, wait_ms: int):
        self.gap, self.wait = pd.Timedelta(milliseconds=gap_ms), wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long")

    def row(self, profile, first: int, last: int, n: int, reload: bool) -> pd.DataFrame:
        return pd.DataFrame({"profile_id": [profile], "start": [pd.Timestamp(first)], "end": [pd.Timestamp(last) + self.gap], "changes": [n], "reload": [reload]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.open.get() if self.open.exists() else (0, 0, 0)
        gap = self.gap.value
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples(index=False):
            at = row.ts.value
            if n and not (first - gap < at < last + gap):
                if at < first:  # late, and of no open run: a run of its own
                    yield self.row(key[0], at, at, 1, bool(row.reload))
                    continue
                yield self.row(key[0], first, last, n, False)
                n = 0
            first, last, n = (min(first, at), max(last, at), n + 1) if n else (at, at, 1)
            if row.reload:
                yield self.row(key[0], first, last, n, True)
                n = 0
        if n:
            self.open.update((first, last, n))
        else:
            self.open.clear()
        reset_timer(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.wait if n else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            first, last, n = self.open.get()
            self.open.clear()
            yield self.row(key[0], first, last, n, False)

    def close(self) -> None:
        pass


def debounced_stream(changes: DataFrame, gap_ms: int, wait_ms: int | None = None) -> DataFrame:
    """Rows (profile_id, start, end, changes, reload): a rebuild for each run of changes (profile_id, ts, reload) with no gap of gap_ms.

    A run closes when a change beyond the gap comes, or wait_ms (gap_ms if not given) of processing time after the last
    batch with a change of it, so the last closes too. A reload fires its run at once. Each profile's changes of a batch
    come to one task, as rows of three numbers.
    """
    use_store(changes.sparkSession)
    return changes.select("profile_id", "ts", "reload").groupBy("profile_id").transformWithStateInPandas(Debounce(gap_ms, gap_ms if wait_ms is None else wait_ms), "profile_id string, start timestamp, end timestamp, changes long, reload boolean", "append", "ProcessingTime")
