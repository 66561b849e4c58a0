"""JSON inputs and outputs: master documents, example registries, derived records, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.master import MASTER
from tracewell.operators.upsert import require_unique

EXAMPLE = (
    "example_id string, review_item_code string, example_version string, approval_status string, loan_types array<string>, "
    "industry_codes array<string>, situation_tags array<string>, input_summary string, output_example string, "
    "style_tags array<string>, forbidden_tokens array<string>"
)


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Master documents, one file per row; the schema is declared, never inferred."""
    docs = spark.read.schema(MASTER).option("multiLine", True).json(path)
    return docs.withColumn("doc_id", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Few-shot registry: a bare list or an object with ``examples``; ids must be unique."""
    inner = ",".join(":".join(p.strip().split(" ", 1)) for p in EXAMPLE.split(", "))
    raw = spark.read.schema(f"examples array<struct<{inner}>>, {EXAMPLE}").option("multiLine", True).json(path)
    listed = raw.where("examples IS NOT NULL").select(F.explode("examples").alias("e")).select("e.*")
    rows = listed.unionByName(raw.where("examples IS NULL").drop("examples"))
    require_unique(rows, ["example_id"])
    none = F.array().cast("array<string>")
    return rows.select(
        "example_id", F.col("review_item_code").alias("review_item"), "approval_status",
        *[F.coalesce(c, none).alias(n) for c, n in (("loan_types", "loan_types"), ("industry_codes", "industry_codes"),
                                                    ("situation_tags", "tags"), ("forbidden_tokens", "forbidden_tokens"))],
        "input_summary", "output_example")


def ready_report(documents: DataFrame) -> DataFrame:
    """The one READY credit report per case; more than one is an error."""
    ready = documents.where("document_kind = 'credit_report' AND status = 'READY'")
    require_unique(ready, ["tenant_id", "case_id"])
    return ready


def write_json(rows: DataFrame, path: str, *partition_by: str) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def opinion_report(sections: DataFrame, references: DataFrame, title: str = "심사의견") -> DataFrame:
    """Markdown report per job: five sections, then the numbered evidence list.

    ``sections``: job_id, review_item, title, text. ``references``: job_id, ref_no, location,
    source_filename. Both are bounded per job by the prompt budget.
    """
    body = sections.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("review_item", F.concat(
        F.lit("## "), "review_item", F.lit(". "), "title", F.lit("\n\n"), "text").alias("t")))).alias("s"))
    notes = references.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ref_no", F.concat(
        F.lit("["), F.col("ref_no").cast("string"), F.lit("] "), "source_filename", F.lit(" · "), "location").alias("t")))).alias("r"))
    return body.join(notes, "job_id", "left").select("job_id", F.concat(
        F.lit(f"# {title}\n\n"), F.array_join("s.t", "\n\n"),
        F.coalesce(F.concat(F.lit("\n\n---\n\n"), F.array_join("r.t", "\n")), F.lit(""))).alias("markdown"))


def template_sections(evidence: DataFrame, most: int = 3, chars: int = 420) -> DataFrame:
    """Deterministic section text that only copies evidence.

    ``evidence``: section, rank, evidence_id, source_class, in_conflict, content. Attachments in
    a direct conflict are used only when nothing else is there.
    """
    from tracewell.functions.text import clean
    from tracewell.operators.topk import top_k

    risky = (F.col("source_class") == "attachment") & F.col("in_conflict")
    marked = evidence.withColumn("_risky", risky.cast("int"))
    safe = marked.groupBy("section").agg(F.min("_risky").alias("_best"))
    usable = marked.join(safe, "section").where((F.col("_best") == 1) | (F.col("_risky") == 0))
    first = top_k(usable, ["section"], [F.asc("rank")], most, "evidence_id", rank="_n")
    said = F.regexp_replace(F.substring(clean(F.col("content")), 1, chars), " +$", "")
    rows = first.withColumn("_t", F.when(said != "", F.concat(said, F.lit(" ["), "evidence_id", F.lit("]"))))
    texts = rows.groupBy("section").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("l"), F.min_by("evidence_id", "_n").alias("e"))
    filled = F.array_compact(F.col("l._t"))
    return texts.select("section", F.when(F.size(filled) > 0, F.concat(F.lit("확인된 근거자료상 "), F.array_join(filled, " "))).otherwise(
        F.concat(F.lit("확인된 근거자료를 기준으로 추가 검토가 필요하다. ["), "e", F.lit("]"))).alias("text"))
