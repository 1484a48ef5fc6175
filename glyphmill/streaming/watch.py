"""The watch cycle as a stream: states of paths with timers, and state that goes.

Every observation of a path (its fingerprint; null: a complete scan did not meet it) is told with the state that it
leads to.  An event-time timer tells of a path that has been held long enough, without another observation.  A path
that is gone is remembered for so long, then its state is dropped by a second timer; should it come back later, it is
a new one.

Defined results: rows without path or time are left out; rows of a path must come in order of time, from batch to
batch, and those later than the watermark are dropped; of rows with one path and time the larger fingerprint counts
last; an incomplete scan gives no missing paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.change import tombstones

STATES = "path string, seen_at timestamp, fingerprint string, since timestamp, state string, event string, timed boolean"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def scan_rows(known: DataFrame, scanned: DataFrame, complete: bool, seen_at) -> DataFrame:
    """Observations of one scan (path, seen_at, fingerprint): what it met and, if it is complete, what it did not."""
    met = scanned.select("path", F.lit(seen_at).cast("timestamp").alias("seen_at"), "fingerprint")
    gone = tombstones(known, scanned, complete).select("path", F.lit(seen_at).cast("timestamp").alias("seen_at"), F.lit(None).cast("string").alias("fingerprint"))
    return met.unionByName(gone)


class Watching(StatefulProcessor):
    """State of a path: when its fingerprint was first seen without a break, what it is, and whether it was told stable.

    Times are microseconds; timers and how long a fingerprint has held go by whole milliseconds."""

    def __init__(self, stability_ms: int, forget_ms: int):
        self.stability, self.forget = stability_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "since long, mark string, stable boolean")

    def _row(self, path: str, at: int, mark: str | None, since: int, event: str | None, timed: bool) -> tuple:
        state = "TOMBSTONED" if mark is None else "STABLE" if at // 1000 - since // 1000 >= self.stability else "CANDIDATE"
        return path, pd.Timestamp(at, unit="us"), mark, pd.Timestamp(since, unit="us"), state, event, timed

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "seen_at", "fingerprint", "since", "state", "event", "timed"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.known.get() if self.known.exists() else None
        since, mark, stable = held or (0, None, False)
        fresh, out = held is None, []
        for row in pd.concat(list(rows)).sort_values(["seen_at", "fingerprint"], na_position="first").itertuples():
            at, new = row.seen_at.value // 1000, None if pd.isna(row.fingerprint) else row.fingerprint
            event = None
            if fresh or new != mark:
                event = "REMOVED" if new is None else "DISCOVERED" if fresh else "REAPPEARED" if mark is None else "CHANGED"
                fresh, since, mark, stable = False, at, new, False
            out.append(self._row(key[0], at, mark, since, event, False))
            stable = out[-1][4] == "STABLE"
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if mark is None:
            self.handle.registerTimer(since // 1000 + self.forget)
        elif not stable:
            self.handle.registerTimer(since // 1000 + self.stability)
        self.known.update((since, mark, stable))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since, mark, _ = self.known.get()
        if mark is None:
            self.known.clear()
            return
        self.known.update((since, mark, True))
        yield self._frame([self._row(key[0], 1000 * expiredTimerInfo.getExpiryTimeInMs(), mark, since, None, True)])


def watch(observations: DataFrame, stability_ms: int, forget_ms: int, late: str = "0 seconds") -> DataFrame:
    """States of a stream of observations (path, seen_at, fingerprint); ``timed`` rows come from timers."""
    observations.sparkSession.conf.set(*ROCKS)  # timers need a store that knows their order
    rows = observations.where("path is not null and seen_at is not null").select("path", "seen_at", "fingerprint").withWatermark("seen_at", late)
    return rows.groupBy("path").transformWithStateInPandas(Watching(stability_ms, forget_ms), STATES, "Append", "EventTime")
