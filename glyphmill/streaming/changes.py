"""Streams of changes: file states with timers kept by path, last writes by item, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = "path string, seen_at timestamp, fingerprint string, since timestamp, state string, event string"


def file_states(observations: DataFrame, stability_ms: int) -> DataFrame:
    """Stream twin of the batch operator: rows of a path must come in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, since, mark = (True, *state.get) if state.exists else (False, None, None)
        out = []
        for pdf in batches:
            for row in pdf.sort_values("seen_at").itertuples():
                now, new = row.seen_at, None if pd.isna(row.fingerprint) else row.fingerprint
                event = None
                if not known:
                    event, since = "REMOVED" if new is None else "DISCOVERED", now
                elif new != mark:
                    event, since = "REMOVED" if new is None else "REAPPEARED" if mark is None else "CHANGED", now
                known, mark = True, new
                held = (now.value - pd.Timestamp(since).value) // 1_000_000 >= stability_ms
                out.append((key[0], now, new, pd.Timestamp(since), "TOMBSTONED" if new is None else "STABLE" if held else "CANDIDATE", event))
        state.update((pd.Timestamp(since).to_pydatetime(), mark))
        yield pd.DataFrame(out, columns=["path", "seen_at", "fingerprint", "since", "state", "event"])

    return observations.groupBy("path").applyInPandasWithState(step, STATES, "since timestamp, mark string", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, ts: str, late: str, size: str, by: str) -> DataFrame:
    """Counts and sums by tumbling window and key; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, late: str, gap: str, by: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def sync(deltas: DataFrame, target: str, checkpoint: str, key: str = "item_key"):
    """Applies delta batches to a table of one directory a version: the last write of each item wins.

    Only a whole batch becomes the next version, so a failed one changes nothing; the stream's checkpoint is the cursor."""
    from ..operators.change import last_writes

    spark = deltas.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        touched = batch.select(key).distinct()
        new = last_writes(batch, key)
        if n:
            new = spark.read.parquet(f"{target}/v{n - 1}").join(touched, key, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{target}/v{n}")

    return deltas.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
