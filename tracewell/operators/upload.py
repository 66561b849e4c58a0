"""Uploaded files to chunk records, with a status for every file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.spans import char_split
from tracewell.operators.layout import coalesce_blocks
from tracewell.operators.registry import upload_records
from tracewell.session import cut_lineage
from tracewell.sources.files import extract_blocks


def process_uploads(files: DataFrame, *, tenant: str, case: str, size: int = 1000, overlap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(records, statuses) of files (path, content).

    Blocks near each other are merged, split, and numbered per file. A file that cannot be read or
    has no text is EXCLUDED with its reason and the others go on; a file's texts are one group, as
    uploads are limited in size.
    """
    blocks = cut_lineage(extract_blocks(files))
    good = blocks.where("error IS NULL").select(F.col("path").alias("document_id"), "page", F.col("block_no").alias("position"), "text", "bbox", "location")
    merged = coalesce_blocks(good, "document_id", max_chars=size)
    pieces = merged.select("document_id", "position", char_split(size, overlap)("text").alias("p"))
    texts = pieces.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "p"))).alias("l")).select(
        "document_id", F.lit(tenant).alias("tenant_id"), F.lit(case).alias("case_id"), F.flatten("l.p").alias("parts"))
    records = upload_records(texts, F.col("parts")).drop("parts")
    counts = texts.select(F.col("document_id").alias("path"), F.size("parts").alias("chunks"))
    failed = blocks.groupBy("path").agg(F.max("error").alias("error"))
    held = failed.join(counts, "path", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("chunks") == 0, "no text")
    return records, held.select("path", F.when(reason.isNull(), "READY").otherwise("EXCLUDED").alias("status"), reason.alias("error"), "chunks")
