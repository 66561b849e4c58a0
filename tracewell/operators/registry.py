"""Rows of the document registry: uploads, audit log, listings and the purge of a case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.identity import upload_chunk_id
from tracewell.operators.claims import padded


def upload_records(documents: DataFrame, parts: Column, *, tenant: str = "tenant_id", case: str = "case_id", document: str = "document_id") -> DataFrame:
    """Chunk records of uploaded texts: one row per part with its local and global id.

    ``parts`` is the array of a document's texts; the number of parts is known in its row.
    """
    rows = documents.select("*", parts.alias("_parts")).withColumn("part_count", F.size("_parts"))
    rows = rows.select("*", F.posexplode("_parts").alias("_n", "embedding_text")).drop("_parts")
    local = F.concat(F.lit("CH_POC_"), padded(F.col("_n") + 1, 5))
    return rows.withColumns({
        "part_index": F.col("_n") + 1, "chunk_id": local,
        "global_chunk_id": upload_chunk_id(F.col(tenant), F.col(case), F.col(document), local)}).drop("_n")


def audit_events(changes: DataFrame, entity: str, kind: str, payload: Sequence[str], *, at: str) -> DataFrame:
    """Audit rows (event_id, entity_id, event_type, payload_json, created_at) of changes.

    The id is a digest of the row, so a change written again after a failure is the same row.
    """
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    said = F.concat_ws("\x1f", F.col(entity).cast("string"), F.col(kind), F.col(at).cast("string"), body)
    return changes.select(F.concat(F.lit("AUD_"), F.substring(F.sha2(said, 256), 1, 20)).alias("event_id"), F.col(entity).alias("entity_id"),
                          F.col(kind).alias("event_type"), body.alias("payload_json"), F.col(at).alias("created_at"))


BATCH = "batch"


def append_audit(events: DataFrame, path: str, batch: str) -> None:
    """Append the events of one batch, named uniquely by the caller, to the log at ``path``.

    Each batch has a partition of its own, which is replaced as a whole when the batch is written again
    after a failure. Rows of other batches are never touched; one with no rows leaves nothing.
    """
    held = events.dropDuplicates(["event_id"]).withColumn(BATCH, F.lit(batch))
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All events of the log; one that several batches hold, such as a source read anew, counts once."""
    return spark.read.parquet(path).drop(BATCH).dropDuplicates(["event_id"])


def purge_case(tables: Mapping[str, DataFrame], cases: DataFrame, key: Sequence[str]) -> dict[str, DataFrame]:
    """Every table without the rows of the purged cases."""
    gone = cases.select(*key).distinct()
    return {name: table.join(gone, list(key), "left_anti") for name, table in tables.items()}


def purge_counts(tables: Mapping[str, DataFrame], cases: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows kept and removed per table, in one pass over each."""
    gone = cases.select(*key).distinct().withColumn("_gone", F.lit(True))
    counted = [table.select(*key).join(gone, list(key), "left").agg(
        F.count_if(F.col("_gone").isNull()).alias("kept"), F.count_if(F.col("_gone")).alias("removed")).withColumn("name", F.lit(name)) for name, table in tables.items()]
    return reduce(DataFrame.unionByName, counted).select("name", "kept", "removed")


def listing_by_kind(documents: DataFrame, case: Sequence[str], kind: str, document: str, order: Sequence[str]) -> DataFrame:
    """Per case the ids of its credit reports and of its attachments in listing order; a case holds few documents."""
    ids = lambda name: F.transform(F.array_sort(F.collect_list(F.when(
        F.col(kind) == name, F.struct(*order, F.col(document).alias("_id"))))), lambda x: x["_id"])
    return documents.groupBy(*case).agg(ids("credit_report").alias("credit_reports"), ids("attachment").alias("attachments"))


def original_rows(prompt: DataFrame, evidence: DataFrame, scope: Sequence[str], key: str = "evidence_id") -> DataFrame:
    """The evidence rows, as they were, that a prompt shows in shortened form."""
    return evidence.join(prompt.select(*scope, key).distinct(), [*scope, key], "left_semi")
