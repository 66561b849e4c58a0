"""The event stream of a job as its reader sees it: events behind a cursor, heartbeats in silence, an end.

One keyed operator with processing-time timers. A job has a few numbers of state; they go when the
job ends, and the mark of its end goes after ``keep_ended``. The events of one micro-batch pass
through the state store in blocks, so that a busy job does not fill a task's memory.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = 1024

JOB_STREAM = (T.StructType().add("job_id", "string").add("sequence", "long").add("event_type", "string")
              .add("verdict", "string").add("at", "timestamp"))
Passed = Row(*JOB_STREAM.names)


def use_timers(spark: SparkSession) -> SparkSession:
    """Timers and state with a lifetime need the RocksDB store; the setting holds for queries started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


@contextmanager
def read_to_the_end(spark: SparkSession) -> Iterator[SparkSession]:
    """Settings for a query, started within, that ends with its input; else timers keep it running for ever."""
    keys = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class JobReader(StatefulProcessor):
    def __init__(self, heartbeat_ms: int, keep_ended_ms: int, after: int):
        self.heartbeat_ms, self.keep_ended_ms, self.after = heartbeat_ms, keep_ended_ms, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", T.StructType().add("sequence", "long"))
        self.ended = handle.getValueState("ended", T.StructType().add("sequence", "long"), self.keep_ended_ms)
        self.passing = handle.getListState("passing", T.StructType().add("sequence", "long").add("event_type", "string"))

    def _timer(self, now: int | None) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if now is not None:
            self.handle.registerTimer(now + self.heartbeat_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        at = _moment(now)
        end = self.ended.get()[0] if self.ended.exists() else None
        seen = self.cursor.get()[0] if self.cursor.exists() else self.after
        # First where this micro-batch ends, since its rows come in no order.
        while block := list(islice(rows, BLOCK)):
            ends = [r.sequence for r in block if r.ends]
            end = min([end] * (end is not None) + ends, default=None)
            self.passing.appendList([(r.sequence, r.event_type) for r in block])
        last = seen
        for sequence, kind in self.passing.get():
            if end is not None and sequence > end:
                yield Passed(key[0], sequence, kind, "refused", at)
            elif sequence > seen:
                last = max(last, sequence)
                yield Passed(key[0], sequence, kind, "event", at)
        self.passing.clear()
        if end is None:
            self.cursor.update((last,))
            self._timer(now)
        else:
            self.cursor.clear()
            self._timer(None)
            self.ended.update((end,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.cursor.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.heartbeat_ms)
        yield Passed(key[0], self.cursor.get()[0], "heartbeat", "heartbeat", _moment(now))

    def close(self) -> None:
        pass


def _moment(ms: int):
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)


def job_stream(events: DataFrame, ends, *, heartbeat_seconds: float = 15.0, keep_ended_seconds: float = 86400.0, after: int = 0) -> DataFrame:
    """What a reader of each job gets: rows of ``JOB_STREAM``.

    ``events``: a stream of job_id, sequence, event_type; ``ends`` says which event ends its job. Events up
    to the end are passed on once each, if behind ``after``; a job of which nothing came for
    ``heartbeat_seconds`` gets a heartbeat with its last sequence, again after each further such time.
    Events behind the end are refused while its mark is kept. A query restarted from its checkpoint goes
    on behind what it has passed on. Needs ``use_timers`` before the query starts.
    """
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("sequence").cast("long").alias("sequence"),
                         F.col("event_type").cast("string").alias("event_type"), F.coalesce(ends, F.lit(False)).alias("ends"))
    reader = JobReader(int(heartbeat_seconds * 1000), int(keep_ended_seconds * 1000), max(0, after))
    return rows.groupBy("job_id").transformWithState(reader, JOB_STREAM, "append", "ProcessingTime")


def audit_sink(path: str, source: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each micro-batch to the log at ``path`` once.

    A batch written again after a failure replaces what it left before.
    """
    from tracewell.operators.registry import append_audit

    return lambda batch, number: append_audit(batch, path, f"{source}-{number}")
