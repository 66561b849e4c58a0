import datetime as dt

from pyspark.sql import functions as F

from tracewell.streaming import events as ev


def run(spark, query_df, name, tmp_path, mode="append"):
    q = (query_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_numbering_and_resume(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "job string, event_id long").coalesce(1).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    source = ev.numbered(ev.read_events(spark, folder, schema), "job", "event_id")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        q = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {(r["job"], r["event_id"]): r["sequence"] for r in spark.read.parquet(out).collect()}

    assert go() == {**{("a", i): i + 1 for i in range(5)}, ("b", 9): 1}
    spark.createDataFrame([("a", 70)], "job string, event_id long").coalesce(1).write.mode("append").parquet(folder)
    assert go()[("a", 70)] == 6  # the restarted query goes on counting


def test_life_cycle(spark, tmp_path):
    folder = str(tmp_path / "req")
    steps = [("d", 1, "UPLOADED", None), ("d", 2, "VALIDATING", None), ("d", 3, "READY", None), ("d", 4, "PARSING", 50), ("d", 5, "INDEXING", 40),
             ("d", 6, "INDEXING", None), ("d", 7, "READY", None), ("d", 8, "DELETING", 100), ("d", 9, "DELETED", None), ("d", 10, "UPLOADED", None),
             ("x", 1, "READY", None), ("y", 1, "UPLOADED", None), ("y", 2, "FAILED", None), ("y", 3, "VALIDATING", None)]
    spark.createDataFrame(steps, "document_id string, event_id long, status string, progress int").coalesce(1).write.parquet(folder)
    rows = run(spark, ev.lifecycle(ev.read_events(spark, folder, spark.read.parquet(folder).schema)), "lc", tmp_path)
    got = {(r["document_id"], r["event_id"]): (r["status"], r["verdict"]) for r in rows}
    assert [got[("d", i)] for i in range(1, 11)] == [
        ("UPLOADED", "registered"), ("VALIDATING", "accepted"), ("VALIDATING", "invalid transition"), ("PARSING", "accepted"),
        ("PARSING", "progress cannot decrease"), ("INDEXING", "accepted"), ("READY", "accepted"), ("DELETING", "accepted"),
        ("DELETED", "accepted"), ("DELETED", "invalid transition")]
    assert got[("x", 1)][1] == "unknown document"
    assert got[("y", 3)] == ("FAILED", "progress cannot decrease")  # 25 is below the 100 of FAILED


def test_order_holds_over_small_pieces(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        folder = str(tmp_path / "req")
        steps = [("d", 4, "INDEXING", None), ("d", 3, "PARSING", None), ("d", 2, "VALIDATING", None), ("d", 1, "UPLOADED", None), ("d", 5, "READY", None)]
        spark.createDataFrame(steps, "document_id string, event_id long, status string, progress int").coalesce(1).write.parquet(folder)
        stream = ev.read_events(spark, folder, spark.read.parquet(folder).schema)
        rows = run(spark, ev.lifecycle(stream), "small_lc", tmp_path)
        assert sorted((r["event_id"], r["status"], r["verdict"]) for r in rows) == [
            (1, "UPLOADED", "registered"), (2, "VALIDATING", "accepted"), (3, "PARSING", "accepted"), (4, "INDEXING", "accepted"), (5, "READY", "accepted")]
        rows = run(spark, ev.numbered(stream, "document_id", "event_id"), "small_num", tmp_path)
        assert all(r["sequence"] == r["event_id"] for r in rows) and len(rows) == 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_idle_sessions_and_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    folder = str(tmp_path / "touch")
    for n, batch in enumerate([[("j1", at(0)), ("j2", at(1))], [("j1", at(20))], [("j1", at(200))], [("j3", at(400))], [("j3", at(401))]]):
        spark.createDataFrame(batch, "job_id string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = ev.read_events(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    rows = run(spark, ev.idle_watch(stream, 30.0), "idle", tmp_path)
    got = {(r["job_id"], r["status"], int((r["at"] - t0).total_seconds())) for r in rows}
    assert {("j1", "RUNNABLE", 0), ("j2", "RUNNABLE", 1), ("j2", "SUSPENDED", 31), ("j1", "SUSPENDED", 50), ("j1", "RUNNABLE", 200), ("j1", "SUSPENDED", 230)} <= got
    rows = run(spark, ev.activity_sessions(stream, "job_id", "30 seconds"), "sess", tmp_path)
    assert {(r["job_id"], r["events"]) for r in rows} >= {("j1", 2), ("j2", 1), ("j1", 1)}
    rows = run(spark, ev.tumbling_counts(stream.withColumn("kind", F.lit("k")), "kind", "1 minute", "10 seconds"), "tumble", tmp_path)
    assert {(int((r["start"] - t0).total_seconds()), r["events"]) for r in rows} >= {(0, 3), (180, 1)}
