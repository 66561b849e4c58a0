"""Structured Streaming over job and document events.

Batch twins live in ``operators.states``. State per key is a few numbers. A key's events of one
micro-batch arrive in pieces; order holds over all of them, so their few columns are put together
first. ``files_per_batch`` bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions import patterns as P


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Event files as a stream. With a checkpoint location a restarted query resumes where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def numbered(events: DataFrame, key: str, event: str) -> DataFrame:
    """Per-key sequence number in order of arrival."""
    kinds = {f.name: f.dataType for f in events.schema}
    out = T.StructType().add(key, kinds[key]).add(event, kinds[event]).add("sequence", "long")
    state_type = T.StructType().add("last", "long")

    def fold(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        part = pd.concat([frame[[key, event]] for frame in frames]).sort_values(event)
        part["sequence"] = range(last + 1, last + 1 + len(part))
        state.update((last + len(part),))
        yield part

    return events.groupBy(key).applyInPandasWithState(fold, out, state_type, "append", GroupStateTimeout.NoTimeout)


def step(status: str | None, progress: int, wanted: str, asked: int | None) -> tuple[str | None, int, str]:
    """One request against the document life cycle: (status, progress, verdict)."""
    if status is None:
        return ("UPLOADED", 0, "registered") if wanted == "UPLOADED" else (None, 0, "unknown document")
    if wanted != status and wanted not in P.TRANSITIONS[status][0]:
        return status, progress, "invalid transition"
    target = P.TRANSITIONS[wanted][1] if asked is None else asked
    if not 0 <= target <= 100:
        return status, progress, "progress out of range"
    if target < progress and wanted not in P.PROGRESS_MAY_FALL:
        return status, progress, "progress cannot decrease"
    return wanted, target, "accepted"


LIFECYCLE = (T.StructType().add("document_id", "string").add("event_id", "long").add("requested", "string")
             .add("status", "string").add("progress", "integer").add("verdict", "string"))


def lifecycle(requests: DataFrame) -> DataFrame:
    """Apply status requests (document_id, event_id, status, progress) in event order.

    A rejected request leaves the state as it was and is reported with its reason.
    """
    state_type = T.StructType().add("status", "string").add("progress", "integer")

    def fold(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, progress = state.get if state.exists else (None, 0)
        rows = []
        for r in pd.concat(list(frames)).sort_values("event_id").itertuples():
            asked = None if pd.isna(r.progress) else int(r.progress)
            status, progress, verdict = step(status, progress, r.status, asked)
            rows.append((keys[0], r.event_id, r.status, status, progress, verdict))
        yield pd.DataFrame(rows, columns=LIFECYCLE.names)
        if status is not None:
            state.update((status, progress))

    return requests.groupBy("document_id").applyInPandasWithState(
        fold, LIFECYCLE, state_type, "append", GroupStateTimeout.NoTimeout)


ACTIVITY = T.StructType().add("job_id", "string").add("status", "string").add("at", "timestamp")


def idle_watch(touches: DataFrame, idle_seconds: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """RUNNABLE when a job shows up again, SUSPENDED once event time passes its idle limit.

    ``touches``: job_id, ts. The same operator with a shorter limit yields heartbeats.
    """
    limit = int(idle_seconds * 1000)
    state_type = T.StructType().add("last_ms", "long")

    def fold(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(keys[0], "SUSPENDED", pd.Timestamp(last + limit, unit="ms"))], columns=ACTIVITY.names)
            return
        last = state.get[0] if state.exists else None
        changes: list[tuple] = []
        for ms in pd.concat([frame["ts"] for frame in frames]).astype("datetime64[ms]").astype("int64").sort_values():
            if last is None:
                changes.append((keys[0], "RUNNABLE", ms))
            elif ms - last >= limit:  # the pause lies inside the data, not behind the watermark
                changes += [(keys[0], "SUSPENDED", last + limit), (keys[0], "RUNNABLE", ms)]
            last = ms if last is None else max(last, ms)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))
        if changes:
            out = pd.DataFrame(changes, columns=ACTIVITY.names)
            yield out.assign(at=pd.to_datetime(out["at"], unit="ms"))

    return touches.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(
        fold, ACTIVITY, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def activity_sessions(events: DataFrame, key: str, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Extension: sessions by event-time gap, closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def tumbling_counts(events: DataFrame, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Extension: events per kind and fixed window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), kind).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").alias("start"), kind, "events")
