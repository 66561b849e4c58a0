"""The event stream of jobs: one pass, an end, heartbeats, restarts; the audit log written twice."""

import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import registry
from tracewell.streaming import events as ev
from tracewell.streaming import replay as rp

EVENTS = "job_id string, sequence long, event_type string"
ENDS = "event_type = 'complete'"


@pytest.fixture
def timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield rp.use_timers(spark)
    spark.conf.set(key, before)


class Job:
    """A running stream over a folder of event files."""

    def __init__(self, spark, tmp_path, **how):
        self.spark, self.folder, self.out, self.cp = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
        self.how = {"heartbeat_seconds": 3600.0} | how

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(self.folder)

    def start(self):
        stream = ev.read_events(self.spark, self.folder, self.spark.createDataFrame([], EVENTS).schema)
        self.query = rp.job_stream(stream, F.expr(ENDS), **self.how).writeStream.format("parquet").option("path", self.out).option(
            "checkpointLocation", self.cp).trigger(processingTime="300 milliseconds").start()
        return self

    def rows(self):
        try:
            return [(r.job_id, r.sequence, r.event_type, r.verdict, r["at"]) for r in self.spark.read.schema(rp.JOB_STREAM).parquet(self.out).collect()]
        except Exception:
            return []

    def until(self, good, seconds=90):
        end = time.time() + seconds
        while time.time() < end and not good(rows := self.rows()):
            assert self.query.exception() is None
            time.sleep(0.5)
        return rows

    def stop(self):
        self.query.stop()


def test_events_pass_once_and_the_end_refuses(timers, tmp_path, monkeypatch):
    monkeypatch.setattr(rp, "BLOCK", 2)
    job = Job(timers, tmp_path, after=1)
    job.put(("a", 3, "token"), ("a", 1, "stage"), ("a", 2, "stage"), ("b", 5, "complete"), ("b", 6, "token"), ("b", 4, "stage"), ("c", 2, "stage"))
    job.start()
    first = job.until(lambda r: len(r) >= 6)
    assert sorted(x[:4] for x in first) == [("a", 2, "stage", "event"), ("a", 3, "token", "event"), ("b", 4, "stage", "event"), ("b", 5, "complete", "event"), ("b", 6, "token", "refused"), ("c", 2, "stage", "event")]
    job.stop()
    # A restarted query goes on behind what it has passed on, and still knows the end.
    job.put(("a", 3, "token"), ("a", 4, "complete"), ("b", 7, "token"), ("c", 1, "stage"), ("c", 3, "token"))
    job.start()
    rows = job.until(lambda r: len(r) >= 9)
    job.stop()
    assert sorted(x[:4] for x in set(rows) - set(first)) == [("a", 4, "complete", "event"), ("b", 7, "token", "refused"), ("c", 3, "token", "event")]


def test_heartbeats_in_silence_until_the_end(timers, tmp_path):
    job = Job(timers, tmp_path, heartbeat_seconds=2.0)
    job.put(("quiet", 1, "stage"), ("done", 1, "complete"))
    job.start()
    rows = job.until(lambda r: sum(x[3] == "heartbeat" for x in r) >= 3)
    beats = sorted(x for x in rows if x[3] == "heartbeat")
    assert len(beats) >= 3 and all(x[:3] == ("quiet", 1, "heartbeat") for x in beats)
    times = sorted([x[4] for x in rows if x[:2] == ("quiet", 1)])
    assert all((b - a).total_seconds() >= 2.0 for a, b in zip(times, times[1:]))  # one for each time of silence
    job.put(("quiet", 2, "complete"))
    rows = job.until(lambda r: any(x[1] == 2 for x in r))
    end = max(x[4] for x in rows if x[1] == 2)
    time.sleep(5)
    assert [x for x in job.rows() if x[4] > end] == []
    job.stop()


def test_the_mark_of_an_end_goes(timers, tmp_path):
    job = Job(timers, tmp_path, keep_ended_seconds=1.0)
    job.put(("a", 1, "complete"))
    job.start()
    job.until(lambda r: len(r) >= 1)
    time.sleep(2)
    job.put(("a", 2, "stage"))
    rows = job.until(lambda r: len(r) >= 2)
    job.stop()
    assert ("a", 2, "stage", "event") in [x[:4] for x in rows]


AUDIT = "event_id string, entity_id string, payload_json string"


def test_a_batch_written_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "audit")
    one, two = [("AUD_1", "d", "{}"), ("AUD_2", "d", None)], [("AUD_3", "e", "{}"), ("AUD_3", "e", "{}")]
    registry.append_audit(spark.createDataFrame(one, AUDIT), path, "s-0")
    registry.append_audit(spark.createDataFrame(two, AUDIT), path, "s-1")
    before = {r.event_id: r.entity_id for r in registry.read_audit(spark, path).collect()}
    registry.append_audit(spark.createDataFrame(two, AUDIT), path, "s-1")
    registry.append_audit(spark.createDataFrame([], AUDIT), path, "s-2")
    rows = registry.read_audit(spark, path).collect()
    assert len(rows) == 3 and {r.event_id: r.entity_id for r in rows} == before
    assert spark.read.parquet(path).where("batch = 's-1'").count() == 1


def test_a_micro_batch_that_failed_after_writing(spark, tmp_path):
    """The sink fails behind the write; the restarted query writes the same batch again."""
    folder, path, cp = (str(tmp_path / n) for n in ("in", "audit", "cp"))
    spark.createDataFrame([(f"AUD_{k}", "d", "{}") for k in range(5)], AUDIT).coalesce(1).write.parquet(folder)
    stream = ev.read_events(spark, folder, spark.read.parquet(folder).schema)
    sink, broken = rp.audit_sink(path, "jobs"), [True]

    def once(batch, number):
        sink(batch, number)
        if broken:
            broken.pop()
            raise RuntimeError("lost")

    def go():
        q = stream.writeStream.foreachBatch(once).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception):
        go()
    go()
    assert spark.read.parquet(path).count() == 5
    spark.createDataFrame([("AUD_9", "d", "{}")], AUDIT).coalesce(1).write.mode("append").parquet(folder)
    go()
    assert sorted(r.event_id for r in registry.read_audit(spark, path).collect()) == [f"AUD_{k}" for k in (0, 1, 2, 3, 4, 9)]
