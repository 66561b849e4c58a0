"""Registry, job and event queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.operators import states
from tracewell.plans.registry import Tables, query
from tracewell.session import shared_folder
from tracewell.streaming import replay
from tracewell.streaming.events import read_events

STATUS_OF = {"click": "VALIDATING", "view": "PARSING", "purchase": "INDEXING", "signup": "READY", "error": "FAILED"}
ORDER = [("ts", True), ("event_id", True)]
SQL_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items()) + " END"
SQL_LOG = f"""
WITH e AS (SELECT event_id, user_id, ts, {SQL_STATUS} AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS progress FROM events),
p AS (SELECT *, lag(status) OVER w AS ps, lag(progress) OVER w AS pp FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _log(t: Tables):
    status = F.lit(None).cast("string")
    for kind, name in STATUS_OF.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return t.events.select("event_id", "user_id", "ts", status.alias("status"), F.get_json_object("props", "$.k").cast("long").alias("progress"))


@query("event_sequence", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events""")
def event_sequence(t: Tables):
    return states.number_events(t.events.select("event_id", "user_id", "ts"), "user_id", ORDER).select("event_id", "user_id", "sequence")


@query("replay_after", """
WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)
SELECT user_id, sequence, event_id, event_type FROM s WHERE sequence > 50""")
def replay_after(t: Tables):
    numbered = states.number_events(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ORDER)
    return states.replay(numbered, 50).select("user_id", "sequence", "event_id", "event_type")


@query("replay_to_end", """
WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events),
e AS (SELECT user_id, min(sequence) AS last FROM s WHERE event_type = 'purchase' GROUP BY user_id)
SELECT s.user_id, sequence, event_id, event_type FROM s LEFT JOIN e USING (user_id) WHERE sequence > 1 AND sequence <= coalesce(last, sequence)""")
def replay_to_end(t: Tables):
    numbered = states.number_events(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ORDER)
    held = states.replay_to_end(numbered, "user_id", F.col("event_type") == "purchase", after=1)
    return held.select("user_id", "sequence", "event_id", "event_type")


@query("heartbeats", """
WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(*) AS events, CAST(sum(CASE WHEN gap > 15000000 THEN (gap - 1) // 15000000 ELSE 0 END) AS BIGINT) AS heartbeats FROM g GROUP BY user_id""")
def heartbeats(t: Tables):
    return states.heartbeats(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")


@query("stream_replay", """
WITH e AS (SELECT user_id, min(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS sequence, event_type, CASE WHEN event_id > last THEN 'refused' ELSE 'event' END AS verdict
FROM events LEFT JOIN e USING (user_id) WHERE event_id > 10 OR event_id > last""")
def stream_replay(t: Tables):
    """The events table as a stream, read to its end: what the reader of each job gets behind its cursor."""
    folder = f"{shared_folder(t.spark)}/jobs-{uuid.uuid4().hex}"
    # A glob also takes a table that is a single file.
    stream = read_events(t.spark, f"{t.folder}/events.parque[t]", t.events.schema, files_per_batch=1_000_000)
    told = stream.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("sequence"), "event_type")
    with replay.read_to_the_end(t.spark):
        running = replay.job_stream(told, F.col("event_type") == "purchase", after=10).writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return t.spark.read.schema(replay.JOB_STREAM).parquet(f"{folder}/out").where("verdict <> 'heartbeat'").drop("at")


@query("illegal_transitions", SQL_LOG + " SELECT event_id, user_id, ps AS previous_status, status FROM p WHERE ps IS NOT NULL AND ps <> status AND NOT ("
       + " OR ".join(f"(ps = '{k}' AND status IN ({', '.join(repr(x) for x in v[0])}))" for k, v in P.TRANSITIONS.items() if v[0]) + ")")
def illegal_transitions(t: Tables):
    audit = states.audit_transitions(_log(t), "user_id", ORDER, "status", "progress")
    return audit.where(~F.col("legal")).select("event_id", "user_id", "previous_status", "status")


@query("progress_violations", SQL_LOG + """
SELECT event_id, user_id, pp AS previous_progress, progress FROM p WHERE progress < pp AND status NOT IN ('FAILED', 'EXCLUDED', 'DELETING', 'DELETED')""")
def progress_violations(t: Tables):
    audit = states.audit_transitions(_log(t), "user_id", ORDER, "status", "progress")
    return audit.where(~F.col("monotone")).select("event_id", "user_id", "previous_progress", "progress")


@query("latest_status", SQL_LOG + """
SELECT user_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress,
  arg_max(event_id, (ts, event_id)) FILTER (WHERE status = 'READY') AS output_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM e GROUP BY user_id""")
def latest_status(t: Tables):
    log = _log(t).withColumn("output_id", F.when(F.col("status") == "READY", F.col("event_id")))
    now = states.current_state(log, ["user_id"], ["ts", "event_id"], ["status", "progress"], ["output_id"], created="ts")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return now.select("user_id", "status", "progress", "output_id", stamp("created_at").alias("created"), stamp("updated_at").alias("updated"))


SQL_IDLE = """
WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
f AS (SELECT *, CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) >= 6 * 3600 * 1000000::BIGINT THEN 1 ELSE 0 END AS s FROM g),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)"""


@query("idle_sessions", SQL_IDLE + """
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM r GROUP BY ALL""")
def idle_sessions(t: Tables):
    runs = states.idle_periods(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 6 * 3600)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return runs.select("user_id", "session", "events", stamp("first_ts"), stamp("last_ts"))


@query("islands", """
WITH g AS (SELECT *, lag(value) OVER w AS pv, lag(event_type) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND abs(value - pv) <= 28.0 AND pt <> 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS members, min(value) AS low, max(value) AS high FROM r GROUP BY ALL""")
def islands(t: Tables):
    near = F.col("pt").isNotNull() & (F.abs(F.col("value") - F.col("pv")) <= 28.0) & (F.col("pt") != "error")
    rows = states.islands(t.events.select("event_id", "user_id", "ts", "value", "event_type"), "user_id", ORDER, ~F.coalesce(near, F.lit(False)), {"pv": "value", "pt": "event_type"})
    return rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("members"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("fair_share", """
WITH j AS (SELECT user_id % 4 AS pool, user_id, min(ts) AS enqueued, max(ts) AS active FROM events GROUP BY ALL),
m AS (SELECT *, CASE WHEN epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(active) < 12 * 3600 * 1000000::BIGINT THEN 'RUNNABLE' ELSE 'SUSPENDED' END AS status FROM j),
n AS (SELECT pool, count(*) FILTER (WHERE status = 'RUNNABLE') AS n FROM m GROUP BY pool)
SELECT pool, user_id, status, n AS runnable_jobs, CASE WHEN status = 'RUNNABLE' THEN row_number() OVER (PARTITION BY pool, status ORDER BY enqueued, user_id) END AS queue_position,
  CASE WHEN status = 'RUNNABLE' THEN round(100.0::DOUBLE / n, 1) ELSE 0.0 END AS fair_share_percent FROM m JOIN n USING (pool)""")
def fair_share(t: Tables):
    jobs = t.events.groupBy((F.col("user_id") % 4).alias("pool"), "user_id").agg(F.min("ts").alias("enqueued"), F.max("ts").alias("active"))
    now = F.lit("2024-01-30 23:00:00").cast(jobs.schema["active"].dataType)
    shares = states.runnable_share(jobs, "pool", "active", "enqueued", "user_id", now, 12 * 3600)
    return shares.select("pool", "user_id", "status", "runnable_jobs", "queue_position", "fair_share_percent")


@query("status_counts", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS running,
  count(*) FILTER (WHERE event_type NOT IN ('error', 'click', 'view')) AS other FROM events GROUP BY user_id""")
def status_counts(t: Tables):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        F.count_if(kind == "error").alias("failed"), F.count_if(kind.isin("click", "view")).alias("running"),
        F.count_if(~kind.isin("error", "click", "view")).alias("other"))


@query("active_dup", """
SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus NOT IN ('F') GROUP BY o_custkey HAVING count(*) > 1""")
def active_dup(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "EXCLUDED").otherwise("READY")
    return states.double_active(t.orders, ["o_custkey"], F.col("o_orderpriority") == "1-URGENT", status)


@query("list_documents", """
SELECT o_orderkey, o_custkey, 'F' AS file_type, o_orderstatus <> 'P' AS can_delete FROM orders WHERE o_orderpriority <> '5-LOW'""")
def list_documents(t: Tables):
    docs = t.orders.where("o_orderpriority <> '5-LOW'").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.concat(F.lit("order."), F.lit("f")).alias("filename"), F.col("o_orderkey").cast("string").alias("document_id"),
        F.when(F.col("o_orderstatus") == "P", "DELETING").otherwise("READY").alias("status"))
    return states.file_rows(docs).orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "file_type", "can_delete")


@query("case_counts", """
WITH o AS (SELECT o_custkey AS custkey, count(*) AS documents FROM orders GROUP BY 1), e AS (SELECT user_id AS custkey, count(*) AS events FROM events GROUP BY 1)
SELECT c_custkey, coalesce(documents, 0) AS documents, coalesce(events, 0) AS events FROM customer LEFT JOIN o ON o.custkey = c_custkey LEFT JOIN e ON e.custkey = c_custkey""")
def case_counts(t: Tables):
    docs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("documents"))
    events = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("events"))
    return t.customer.select("c_custkey").join(docs, "c_custkey", "left").join(events, "c_custkey", "left").fillna(0)


@query("case_purge", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def case_purge(t: Tables):
    purged = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(purged, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("session_user", """
SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'""")
def session_user(t: Tables):
    sessions = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return sessions.join(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("expired", """
SELECT event_id, epoch_us(ts) + 86400 * 1000000::BIGINT <= epoch_us(TIMESTAMP '2024-01-20 00:00:00') AS expired FROM events""")
def expired(t: Tables):
    now = F.lit("2024-01-20 00:00:00").cast(t.events.schema["ts"].dataType)
    return t.events.select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY") <= now).alias("expired"))
