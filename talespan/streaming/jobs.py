"""Streams: a one-slot job registry, and event-time windows (an extension).

The registry folds job events in order: one job runs at a time; a second submission is refused as
busy, a cancellation without a running job as not running, one of another job as a mismatch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPLIES = T.StructType().add("slot", "string").add("seq", "long").add("kind", "string").add("job", "string").add("reply", "string").add("running", "string")


def step(running: str, kind: str, job: str) -> tuple[str, str]:
    """The reply to one event, and the job that runs after it ("" for none)."""
    if kind == "submit":
        return ("busy", running) if running else ("started", job)
    if kind == "status":
        return ("running" if running else "idle"), running
    if not running:
        return "not_running", ""
    if job != running:
        return "id_mismatch", running
    return {"cancel": "cancelled", "done": "done", "fail": "failed"}.get(kind, "unknown"), "" if kind in ("cancel", "done", "fail") else running


def _fold(slot: str, rows: pd.DataFrame, running: str) -> tuple[pd.DataFrame, str]:
    out = []
    for r in rows.sort_values("seq").itertuples():
        reply, running = step(running, r.kind, r.job)
        out.append((slot, r.seq, r.kind, r.job, reply, running))
    return pd.DataFrame(out, columns=REPLIES.names), running


def registry(events: DataFrame) -> DataFrame:
    """Replies to a stream of (slot, seq, kind, job); the state of a slot is the job that runs."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        running = state.get[0] if state.exists else ""
        frame, running = _fold(key[0], pd.concat(list(batches)), running)
        state.update((running,))
        yield frame

    return events.groupBy("slot").applyInPandasWithState(run, REPLIES, T.StructType().add("running", "string"), "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame) -> DataFrame:
    """The same over a finished table, each slot in order of seq."""
    return events.groupBy("slot").applyInPandas(lambda key, rows: _fold(key[0], rows, "")[0], REPLIES)


def by_priority(requests: DataFrame, slice_size: int = 15) -> DataFrame:
    """Order in which a two-queue worker serves texts: all of priority requests first, then
    background requests in slices."""
    return requests.withColumn("slice", F.floor(F.col("idx") / slice_size)).orderBy(F.desc("priority"), "request", "slice", "idx")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows; works on a stream and on a table."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
