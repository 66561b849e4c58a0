"""Source views: which pieces of evidence a reader sees as one place in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import strip
from tracewell.operators.ordered import ordered_columns
from tracewell.operators.topk import first_rows


def first_row(cell_range: Column) -> Column:
    return F.regexp_extract(F.coalesce(cell_range, F.lit("")), r"(\p{Nd}+)", 1).try_cast("int")


def row_band(cell_range: Column, rows: int = 12) -> Column:
    return F.floor((first_row(cell_range) - 1) / F.lit(rows)).cast("int")


def view_key(source_class: Column, document: Column, *, sheet: Column, cell_range: Column, page: Column,
             table: Column, location: Column, bbox: Column, step: float = 90.0) -> Column:
    """Worksheet band for credit rows; page with table, location or coarse box for attachments."""
    has_row = first_row(cell_range).isNotNull() & (first_row(cell_range) != 0)
    band = F.when(has_row, row_band(cell_range).cast("string")).otherwise(F.coalesce(cell_range, F.lit("")))
    coarse = F.array_join(F.transform(bbox, lambda v: F.bround(v / step).cast("long").cast("string")), ",")
    table_id, place = strip(table), strip(location)
    region = (
        F.when(table_id != "", F.concat(F.lit("table:"), table_id))
        .when(place != "", F.concat(F.lit("location:"), place))
        .when(F.size(bbox) == 4, F.concat(F.lit("bbox:"), coarse))
        .otherwise("page")
    )
    sep = "\x1f"
    return F.when(
        source_class == "credit_report",
        F.concat_ws(sep, F.lit("credit_report"), document, F.coalesce(sheet, F.lit("")), band),
    ).otherwise(F.concat_ws(sep, F.lit("attachment"), document, F.coalesce(page, F.lit(0)).cast("string"), region))


def reference_numbers(cited: DataFrame, case: str, key: str, position: str, evidence_id: str) -> DataFrame:
    """Number the distinct source views of a case in order of first citation.

    One row per cited evidence id with ``ref_no`` and the representative of its view. Only the
    first citation of each view is ordered; the members join back by key.
    """
    views = first_rows(cited.select(case, key, position, evidence_id), [case, key], [position])
    numbered = ordered_columns(
        views.select(case, key, position, F.col(evidence_id).alias("representative_id")),
        [case], [(position, True)], number="ref_no",
    ).drop(position)
    return cited.join(numbered, [case, key])


def view_extent(cited: DataFrame, case: str, key: str, bbox: str) -> DataFrame:
    """Bounding box and member count of each view (mergeable, so a huge view is no problem)."""
    at = lambda i: F.get(F.col(bbox), i)
    return cited.groupBy(case, key).agg(
        F.count(F.lit(1)).alias("members"), F.min(at(0)).alias("x0"), F.min(at(1)).alias("y0"),
        F.max(at(2)).alias("x1"), F.max(at(3)).alias("y1"))


def location_label(source_class: Column, sheet: Column, cell_range: Column, page: Column, table: Column, location: Column) -> Column:
    """Where a reader finds the view: sheet and cells, or page and table or place."""
    some = lambda c, other: F.coalesce(F.when(strip(c) != "", strip(c)), F.lit(other))
    label = F.coalesce(F.when(strip(table) != "", strip(table)), strip(location))
    where = F.when(page.isNotNull() & (page != 0), F.concat(page.cast("string"), F.lit("페이지"))).otherwise("원문")
    return F.when(source_class == "credit_report", F.concat(some(sheet, "시트"), F.lit(" · "), some(cell_range, "범위"))).otherwise(
        F.when(label != "", F.concat(where, F.lit(" · "), label)).otherwise(where))


def trace_references(cited: DataFrame, case: str) -> DataFrame:
    """One row per numbered source view of a case with what to highlight in it.

    ``cited``: <case>, position, the columns of ``assemble``. Highlights are the distinct boxes and
    cell ranges of the cited rows; a view is one place of a document, which bounds both lists.
    """
    keyed = cited.withColumn("view", view_key(
        F.col("source_class"), F.col("document_id"), sheet=F.col("sheet_name"), cell_range=F.col("cell_range"), page=F.col("page"),
        table=F.coalesce("logical_table_id", F.lit("")), location=F.coalesce("location", F.lit("")), bbox=F.col("bbox")))
    numbered = reference_numbers(keyed, case, "view", "position", "evidence_id")
    shown = numbered.withColumn("_where", location_label(
        F.col("source_class"), F.col("sheet_name"), F.col("cell_range"), F.col("page"), F.coalesce("logical_table_id", F.lit("")), F.coalesce("location", F.lit(""))))
    return shown.groupBy(case, "ref_no").agg(
        F.first("representative_id").alias("representative_id"), F.count_distinct("evidence_id").alias("members"), F.min_by("source_class", "position").alias("source_class"),
        F.min_by("source_filename", "position").alias("source_filename"), F.min_by("page", "position").alias("page"), F.min_by("_where", "position").alias("location"),
        F.array_sort(F.collect_set("bbox")).alias("highlight_bboxes"), F.array_sort(F.collect_set("cell_range")).alias("highlight_cell_ranges"))
