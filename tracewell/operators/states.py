"""Event logs: sequences, state audits, current state, idle periods and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.operators.ordered import Order, ordered_columns


def seconds(n: float) -> Column:
    """Interval of ``n`` seconds; differences of timestamps compare with it in any zone."""
    return F.make_dt_interval(secs=F.lit(n).cast("decimal(18,6)"))


def number_events(events: DataFrame, job: str, order: Order, name: str = "sequence") -> DataFrame:
    return ordered_columns(events, [job], order, number=name)


def replay(events: DataFrame, after: int, sequence: str = "sequence") -> DataFrame:
    """Events behind a cursor. Numbering is stored, so a reader can resume anywhere."""
    return events.where(F.col(sequence) > max(0, after))


def replay_to_end(events: DataFrame, job: str, ends: Column, sequence: str = "sequence", after: int = 0) -> DataFrame:
    """Events behind a cursor up to the first that ends its job; of a job without one, all."""
    last = events.where(ends).groupBy(F.col(job).alias("_job")).agg(F.min(sequence).alias("_end"))
    held = events.join(last, F.col(job) == F.col("_job"), "left").where((F.col(sequence) <= F.col("_end")) | F.col("_end").isNull())
    return replay(held, after, sequence).drop("_job", "_end")


def heartbeats(events: DataFrame, job: str, ts: str, tie: str, silent_seconds: float = 15.0) -> DataFrame:
    """Per job its events and how often nothing had come for ``silent_seconds`` since the last event or heartbeat."""
    seen = ordered_columns(events, [job], [(ts, True), (tie, True)], lag={"_before": ts})
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    beats = F.greatest(F.ceil(gap / F.lit(int(silent_seconds * 1_000_000))) - 1, F.lit(0))
    return seen.groupBy(job).agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce(beats, F.lit(0)).cast("long")).alias("heartbeats"))


def _allowed(source: Column, target: Column) -> Column:
    legal = F.lit(False)
    for status, (nexts, _) in P.TRANSITIONS.items():
        if nexts:
            legal = legal | ((source == status) & target.isin(*nexts))
    return legal | (source == target)


def default_progress(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (_, progress) in P.TRANSITIONS.items():
        out = F.when(status == name, progress).otherwise(out)
    return out


def progress_stage(status: Column) -> Column:
    # Fixed display texts per status.
    labels = {"UPLOADED": "업로드 완료", "VALIDATING": "파일검증", "PARSING": "파일해석", "INDEXING": "벡터임베딩", "READY": "완료",
              "FAILED": "사용 제외(레거시)", "EXCLUDED": "사용 제외", "DELETING": "삭제중", "DELETED": "삭제완료"}
    out = F.lit(None).cast("string")
    for name, label in labels.items():
        out = F.when(status == name, label).otherwise(out)
    return out


def audit_transitions(events: DataFrame, key: str, order: Order, status: str, progress: str) -> DataFrame:
    """Previous state of each event and whether the step was legal and monotone."""
    seen = ordered_columns(events, [key], order, lag={"previous_status": status, "previous_progress": progress})
    first = F.col("previous_status").isNull()
    return seen.withColumns({
        "legal": first | _allowed(F.col("previous_status"), F.col(status)),
        "monotone": first | (F.col(progress) >= F.col("previous_progress")) | F.col(status).isin(*P.PROGRESS_MAY_FALL)})


def job_regressions(events: DataFrame, job: str, order: Order, stage: str, progress: str) -> DataFrame:
    """Job progress must not fall unless the job failed."""
    seen = ordered_columns(events, [job], order, lag={"previous_progress": progress})
    return seen.where((F.col(progress) < F.col("previous_progress")) & (F.col(stage) != "FAILED"))


def current_state(events: DataFrame, key: Sequence[str], order: Sequence[str], latest: Sequence[str],
                  keep_last_known: Sequence[str] = (), created: str | None = None) -> DataFrame:
    """Latest row per key; ``keep_last_known`` columns keep their last non-null value.

    ``max_by`` merges map-side, so a key with a third of all events costs nothing extra.
    """
    at = F.struct(*order)
    aggs = [F.max_by(c, at).alias(c) for c in latest]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep_last_known]
    if created:
        aggs += [F.min(created).alias("created_at"), F.max(created).alias("updated_at")]
    return events.groupBy(*key).agg(*aggs)


def islands(rows: DataFrame, key: str, order: Order, starts: Column, previous: Mapping[str, str], name: str = "island") -> DataFrame:
    """Number runs of neighbouring rows; ``starts`` may use the previous values."""
    seen = ordered_columns(rows, [key], order, lag=dict(previous))
    flagged = seen.withColumn("_start", F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return ordered_columns(flagged, [key], order, running={name: "_start"}).drop("_start")


def idle_periods(events: DataFrame, key: str, ts: str, tie: str, limit_seconds: float) -> DataFrame:
    """Activity sessions per key split where nothing happened for ``limit_seconds``."""
    idle = (F.col(ts) - F.col("_before")) >= seconds(limit_seconds)
    runs = islands(events, key, [(ts, True), (tie, True)], F.col("_before").isNull() | idle, {"_before": ts}, "session")
    return runs.groupBy(key, "session").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"))


def runnable_share(jobs: DataFrame, pool: str, last_activity: str, enqueued: str, job: str, now: Column, idle_seconds: float) -> DataFrame:
    """Status, queue position and equal share of the jobs of a pool at a moment."""
    active = (now - F.col(last_activity)) < seconds(idle_seconds)
    marked = jobs.withColumn("status", F.when(active, "RUNNABLE").otherwise("SUSPENDED"))
    counts = marked.groupBy(pool).agg(F.count_if(F.col("status") == "RUNNABLE").alias("runnable_jobs"))
    queue = ordered_columns(marked.where("status = 'RUNNABLE'"), [pool], [(enqueued, True), (job, True)], number="queue_position")
    rest = marked.where("status = 'SUSPENDED'").withColumn("queue_position", F.lit(None).cast("long"))
    share = F.when(F.col("status") == "RUNNABLE", F.round(100.0 / F.greatest(F.lit(1), F.col("runnable_jobs")), 1)).otherwise(0.0)
    return queue.unionByName(rest).join(counts, pool).withColumn("fair_share_percent", share)


def double_active(documents: DataFrame, case: Sequence[str], kind: Column, status: Column) -> DataFrame:
    """Cases with more than one active credit report."""
    active = kind & ~status.isin("EXCLUDED", "DELETED")
    return documents.groupBy(*case).agg(F.count_if(active).alias("active")).where(F.col("active") > 1)


def file_rows(documents: DataFrame) -> DataFrame:
    """Listing columns of registered files."""
    suffix = F.upper(F.regexp_extract("filename", r".\.([^.]+)$", 1))
    return documents.withColumns({
        "file_type": F.when(suffix == "", "FILE").otherwise(suffix), "progress_stage": progress_stage(F.col("status")),
        "is_demo": F.startswith("document_id", F.lit("demo-")), "can_delete": ~F.col("status").isin("DELETING", "DELETED")})
