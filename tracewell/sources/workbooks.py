"""Credit facts from workbook cells: mapped ranges and the seven-sheet layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.identity import evidence_id
from tracewell.functions.text import strip
from tracewell.operators.ordered import ordered_columns

MAPPING = (
    "field_id string, field_name string, sheet_name string, cell_range string, review_items array<string>, common boolean, "
    "unit string, unit_cell string, period string, period_cell string"
)
ALL_ITEMS = ["A", "B", "C", "D", "E"]
# Default review items per sheet, in priority order, and section titles.
SHEET_ITEMS = {
    "7. 종합의견": ALL_ITEMS,
    "6. 신용평가표": ALL_ITEMS,
    "3. 재무현황": ["A", "B", "C", "D"],
    "5. 추정재무현황": ["A", "B", "C", "D"],
    "2. 영업현황": ["B", "E"],
    "4. 분식체크": ["C", "D"],
    "1. 업체현황": ALL_ITEMS,
}
SECTION_ITEMS = [
    (["재무제표 주요계정(현황 및 향후전망)"], ["A"]),
    (["수익성(현황 및 향후전망)"], ["B"]),
    (["재무안정성 및 자산의 질(현황 및 향후전망)"], ["C"]),
    (["현금흐름 및 채무상환능력(현황 및 향후전망)"], ["D"]),
    (["주요 매출처 및 매출비중 변동 추이"], ["E"]),
    (["금융기관별 차입금 추이", "과목별 차입금 추이", "계정과목별 차입금 추이"], ["C", "D"]),
    (["현금흐름표"], ["D"]),
]


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rows of a template file (template_id, version, mappings[])."""
    raw = spark.read.schema(f"template_id string, version string, mappings array<struct<{_colons(MAPPING)},cell:string>>").option(
        "multiLine", True).json(path)
    m = raw.select("template_id", "version", F.explode("mappings").alias("m")).select("template_id", "version", "m.*")
    m = m.withColumns({
        "field_name": F.coalesce("field_name", "field_id"), "cell_range": F.coalesce("cell_range", "cell"),
        "review_items": F.coalesce("review_items", F.array().cast("array<string>")), "common": F.coalesce("common", F.lit(False))}).drop("cell")
    broken = (~F.col("common")) & (F.size("review_items") == 0)
    return m.withColumn("field_id", F.when(broken, F.raise_error(F.concat(
        F.lit("field "), "field_id", F.lit(" needs review_items or common=true"))).cast("string")).otherwise(F.col("field_id")))


def _colons(ddl: str) -> str:
    return ",".join(":".join(part.strip().split(" ", 1)) for part in ddl.split(", "))


def _column_no(c: Column) -> Column:
    letters = F.reverse(F.split(F.regexp_extract(c, "([A-Z]+)", 1), ""))
    places = F.filter(letters, lambda x: x != "")
    return F.aggregate(F.reverse(places), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def _row_no(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


def mapped_facts(cells: DataFrame, mapping: DataFrame, scope: tuple[Column, Column, Column], filename: Column) -> DataFrame:
    """One fact per filled cell of every mapped range.

    The range test is a residual of an equi join on the sheet. Unit and period come from the
    mapping or from a referenced cell of the same sheet and file. The cells are read once: a
    referenced cell is kept beside the facts of its file until they have taken its value.
    """
    first, last = F.element_at(F.split("cell_range", ":"), 1), F.element_at(F.split("cell_range", ":"), -1)
    boxes = mapping.withColumns({
        "c0": _column_no(first), "c1": _column_no(last), "r0": _row_no(first), "r1": _row_no(last)}).withColumnRenamed("sheet_name", "sheet")
    inside = (F.trim(F.coalesce("value", F.lit(""))) != "") & F.col("col").between(F.col("c0"), F.col("c1")) & F.col("row").between(F.col("r0"), F.col("r1"))
    refers = {name: F.col("coordinate") == F.col(name + "_cell") for name in ("unit", "period")}
    # A template has few rows and its few sheets are in every file: dealt by sheet, all cells would meet in a few tasks.
    near = cells.join(F.broadcast(boxes), "sheet").withColumn("_inside", F.coalesce(inside, F.lit(False))).where(
        F.col("_inside") | refers["unit"] | refers["period"])
    alike = Window.partitionBy("path", "sheet", "unit_cell", "period_cell")
    hits = near.withColumns({name: F.coalesce(name, F.max(F.when(at, F.col("value"))).over(alike)) for name, at in refers.items()}).where("_inside")
    field = F.when(F.col("cell_range") == F.col("coordinate"), F.col("field_id")).otherwise(F.concat_ws(":", "field_id", "coordinate"))
    hits = hits.withColumn("_f", field)
    return hits.select(
        evidence_id("FACT", *scope, F.col("_f"), F.col("coordinate")).alias("fact_id"), F.col("_f").alias("field_id"), "field_name", "value",
        "unit", "period", "review_items", "common", scope[2].alias("document_id"), filename.alias("source_filename"),
        F.col("sheet").alias("sheet_name"), F.col("coordinate").alias("cell_range"), "formula", "source_hash")


def missing_sheets(cells: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Per file the sheets it should have and lacks."""
    names = F.array(*[F.lit(s) for s in (wanted or list(SHEET_ITEMS))])
    have = cells.groupBy("path").agg(F.collect_set("sheet").alias("have"))
    return have.select("path", F.array_except(names, "have").alias("missing")).where(F.size("missing") > 0)


def semantic_facts(cells: DataFrame, scope: tuple[Column, Column, Column], filename: Column) -> DataFrame:
    """One fact per filled row of the seven sheets, routed by the last section title seen."""
    filled = cells.withColumn("text", strip(F.col("value"))).where((F.col("text") != "") & F.col("sheet").isin(*SHEET_ITEMS))
    rows = filled.groupBy("path", "source_hash", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "coordinate", "text"))).alias("c"))
    rows = rows.withColumn("row_text", F.array_join(F.transform("c", lambda x: F.concat(x["coordinate"], F.lit("="), x["text"])), " | "))
    items = lambda names: F.array(*[F.lit(n) for n in names])
    seen = F.lit(None).cast("array<string>")
    for titles, names in reversed(SECTION_ITEMS):
        test = F.lit(False)
        for title in titles:
            test = test | F.contains("row_text", F.lit(title))
        seen = F.when(test, items(names)).otherwise(seen)
    default, order = F.lit(None).cast("array<string>"), F.lit(None).cast("int")
    for position, (sheet, names) in enumerate(SHEET_ITEMS.items()):
        default = F.when(F.col("sheet") == sheet, items(names)).otherwise(default)
        order = F.when(F.col("sheet") == sheet, position).otherwise(order)
    carried = ordered_columns(rows.withColumn("_seen", seen), ["path", "sheet"], [("row", True)], carry={"_items": "_seen"}, bounded=True)  # a sheet has a fixed most of rows
    field = F.concat("sheet", F.lit(":row:"), F.col("row").cast("string"))
    carried = carried.withColumns({"_field": field, "sheet_order": order})
    return carried.select(
        evidence_id("FACT", *scope, F.col("_field")).alias("fact_id"), F.col("_field").alias("field_id"),
        F.concat("sheet", F.lit(" "), F.col("row").cast("string"), F.lit("행")).alias("field_name"), F.col("row_text").alias("value"),
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("period"),
        F.coalesce("_items", default).alias("review_items"), F.lit(False).alias("common"), scope[2].alias("document_id"),
        filename.alias("source_filename"), F.col("sheet").alias("sheet_name"),
        F.concat(F.get("c", 0)["coordinate"], F.lit(":"), F.element_at("c", -1)["coordinate"]).alias("cell_range"), "source_hash",
        "sheet_order", "row")
