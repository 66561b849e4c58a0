"""Semi-structured documents to traceable chunks.

A document is one row with nested arrays. Selecting blocks, filling merged cells, header paths
and rendering are array expressions on that row; only header inheritance joins tables with
each other (on document and table id). ``docs`` has the columns doc_id and the ones of
``MASTER``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.lookups import heading_paths, positions_outside
from tracewell.functions.packing import pack_blocks, pack_rows
from tracewell.functions.text import clean, consecutive_distinct, content_type, let
from tracewell.operators.chunks import markdown_row
from tracewell.operators.upsert import require_unique

_ITEM = "struct<text:string,page:int,bbox:array<double>,source_table_id:string,assignment_source:string,confidence:double>"
_MERGE = "struct<row:int,column:int,row_span:int,col_span:int>"
_TABLE = (
    "struct<table_id:string,page:int,bbox:array<double>,matrix:array<array<string>>,"
    f"merge_evidence:array<{_MERGE}>,header_depth:int,stub_column_count:int,column_count:int,row_count:int,"
    "logical_table_id:string,inherited_header:struct<source_table_id:string,source_page:int>,"
    f"title:{_ITEM},units:array<{_ITEM}>,notes:array<{_ITEM}>,"
    f"logical_context:struct<titles:array<{_ITEM}>,units:array<{_ITEM}>,notes:array<{_ITEM}>>>"
)
MASTER = (
    "annotation struct<body_text:array<struct<object_id:string,page:int,bbox:array<double>,text:string,scope_heading_id:string>>,"
    "page_furniture:array<struct<page:int,bbox:array<double>>>>,"
    "semantic_elements struct<headings:array<struct<element_id:string,text:string,parent_id:string,page:int,bbox:array<double>>>,"
    f"tables:array<{_TABLE}>>,"
    "raw_document struct<physical_tables:array<struct<page:int,bbox:array<double>>>>,"
    "table_continuity array<struct<to:string,status:string,parent_child_mapping:struct<successor_columns_per_parent:array<int>>>>"
)
# Mandatory sections, level names and labels of the renderings.
REQUIRED = ("annotation", "semantic_elements", "raw_document")
LEVELS = {0: "plain", 1: "structured", 2: "hierarchical"}
ROW_LABEL, COLUMN_LABEL, STUB_LABEL = "행", "열", "구분"
UNIT_LABEL, NOTE_LABEL = "단위: ", "주석: "


def missing_sections(docs: DataFrame) -> DataFrame:
    """Documents with the mandatory sections they lack (an error column, not an exception)."""
    gaps = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED]))
    return docs.withColumn("missing", gaps)


def _many(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _span(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0 (sequence would count downwards)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


# --- text blocks ----------------------------------------------------------------------------

def box_key(page: Column, bbox: Column) -> Column:
    return F.concat_ws("|", page.cast("string"), F.transform(bbox, lambda v: F.bround(v, 2).cast("string")))


def semantic_key(page: Column, bbox: Column, body: Column) -> Column:
    return F.concat_ws("|", box_key(page, bbox), clean(body))


def center_inside(bbox: Column, outer: Column) -> Column:
    x, y = (F.get(bbox, 0) + F.get(bbox, 2)) / 2.0, (F.get(bbox, 1) + F.get(bbox, 3)) / 2.0
    return x.between(F.get(outer, 0), F.get(outer, 2)) & y.between(F.get(outer, 1), F.get(outer, 3))


def in_margin(bbox: Column, page_height: Column, share: float = 0.08) -> Column:
    """Block in the top or bottom margin of its page."""
    height = F.greatest(page_height.cast("double"), F.lit(1.0))
    return (F.get(bbox, 3) <= height * share) | (F.get(bbox, 1) >= height * (1 - share))


def body_blocks(docs: DataFrame) -> DataFrame:
    """Adds ``blocks``: body text in reading order without headings, captions, page furniture
    and text that lies inside a table."""
    items = f"array<{_ITEM}>"

    def captions(t: Column) -> Column:
        context = t["logical_context"]
        title = F.when(t["title"].isNotNull(), F.array(t["title"])).otherwise(F.array().cast(items))
        return F.concat(title, *[_many(x, items) for x in (
            t["units"], t["notes"], context["titles"], context["units"], context["notes"])])

    headings = F.coalesce("semantic_elements.headings", F.array().cast(
        "array<struct<element_id:string,text:string,parent_id:string,page:int,bbox:array<double>>>"))
    tables = _many(F.col("semantic_elements.tables"), f"array<{_TABLE}>")
    named = F.flatten(F.transform(tables, captions))
    excluded = F.array_distinct(F.concat(
        F.transform(headings, lambda h: semantic_key(h["page"], h["bbox"], h["text"])),
        F.transform(F.filter(named, lambda x: F.size(x["bbox"]) > 0), lambda x: semantic_key(x["page"], x["bbox"], x["text"]))))
    boxes = "array<struct<page:int,bbox:array<double>>>"
    furniture = F.transform(F.filter(_many(F.col("annotation.page_furniture"), boxes), lambda f: F.size(f["bbox"]) > 0),
                            lambda f: box_key(f["page"], f["bbox"]))
    areas = _many(F.col("raw_document.physical_tables"), boxes)
    body = _many(F.col("annotation.body_text"),
                 "array<struct<object_id:string,page:int,bbox:array<double>,text:string,scope_heading_id:string>>")
    said = F.transform(body, lambda b: F.struct(
        b["page"].alias("page"), b["object_id"].alias("object_id"), b["bbox"].alias("bbox"), clean(b["text"]).alias("text"),
        b["scope_heading_id"].alias("scope")))
    held = docs.withColumn("_said", said)
    # A lookup in a lambda is run for every element, with all that its list is made of; sets are looked up once a row.
    held = held.withColumn("_outside", positions_outside(
        F.transform("_said", lambda b: F.concat_ws("|", box_key(b["page"], b["bbox"]), b["text"])),
        F.transform("_said", lambda b: box_key(b["page"], b["bbox"])), excluded, furniture))
    kept = let(areas, lambda held: F.filter(
        F.transform("_outside", lambda i: F.get("_said", i)), lambda b: (b["text"] != "") & (F.size(b["bbox"]) > 0)
        & ~F.exists(held, lambda a: (a["page"] == b["page"]) & center_inside(b["bbox"], a["bbox"]))))
    placed = F.transform(kept, lambda b, i: F.struct(
        b["page"].alias("page"), F.get(b["bbox"], 1).alias("y"), F.get(b["bbox"], 0).alias("x"), i.alias("i"),
        b["object_id"].alias("object_id"), b["bbox"].alias("bbox"), b["text"].alias("text"), b["scope"].alias("scope")))
    return held.withColumn("blocks", F.array_sort(placed)).drop("_said", "_outside")


def heading_path_in(headings: Column, start: Column) -> Column:
    """Titles from the root to ``start`` within one document; cycles and gaps end the walk."""
    state = F.struct(start.alias("at"), F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, _: Column) -> Column:
        # Of equal ids the last heading counts.
        hit = let(F.filter(headings, lambda h: h["element_id"] == s["at"]), lambda f: F.try_element_at(f, F.lit(-1)))
        go = s["at"].isNotNull() & (s["at"] != "") & ~F.array_contains(s["seen"], s["at"]) & hit.isNotNull()
        title = clean(hit["text"])
        path = F.when(title != "", F.array_prepend(s["path"], title)).otherwise(s["path"])
        return F.when(go, F.struct(hit["parent_id"].alias("at"), path.alias("path"), F.array_append(s["seen"], s["at"]).alias("seen"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("at"), s["path"].alias("path"), s["seen"].alias("seen")))

    return F.aggregate(headings, state, step)["path"]


def text_windows(docs: DataFrame, max_chars: int = 4000, overlap: int = 240) -> DataFrame:
    """One row per text chunk: packed blocks of one heading, with the heading path."""
    _check_sizes(max_chars, overlap)
    held = body_blocks(docs).withColumns({
        "_costs": F.transform("blocks", lambda b: F.length(b["text"]) + 1),
        "_scopes": F.transform("blocks", lambda b: b["scope"])})
    packed = held.withColumn("_w", pack_blocks(max_chars, overlap)("_costs", "_scopes"))
    heads = F.coalesce("semantic_elements.headings", F.array().cast("array<struct<element_id:string,text:string,parent_id:string,page:int,bbox:array<double>>>"))
    packed = packed.withColumn("_paths", heading_paths(
        F.transform(heads, lambda h: h["element_id"]), F.transform(heads, lambda h: h["parent_id"]), F.transform(heads, lambda h: clean(h["text"])),
        F.transform("_w", lambda w: F.get("_scopes", w["start"]))))
    # Every window takes its own blocks before the rows part, so that none carries the whole document.
    windows = F.zip_with("_w", "_paths", lambda w, path: F.struct(
        path.alias("path"), F.transform(F.sequence(w["start"], w["stop"] - 1), lambda i: F.get("blocks", i)).alias("b")))
    # The outer form keeps the optimizer from copying the packing UDF into a filter below it.
    rows = packed.select("doc_id", F.posexplode_outer(windows).alias("n", "w")).where("w IS NOT NULL").select(
        "doc_id", "n", F.col("w.b").alias("b"), F.col("w.path").alias("section_path"))
    first = F.get("b", 0)
    rows = rows.withColumn("content", F.array_join("b.text", "\n"))
    return rows.select(
        "doc_id", F.lit("text").alias("kind"),
        F.concat(F.lit("CH_TEXT_"), _pad(F.col("n") + 1, 5)).alias("chunk_id"),
        F.struct(first["page"].alias("page"), first["y"].alias("y"), F.lit(0).alias("kind"), F.lit(0).alias("part")).alias("sort_key"),
        F.array_sort(F.array_distinct("b.page")).alias("pages"), F.col("b.object_id").alias("object_ids"), F.col("b.bbox").alias("bboxes"),
        "section_path", "content", F.array_join(F.concat("section_path", F.array("content")), "\n").alias("plain"))


def _pad(n: Column, width: int) -> Column:
    digits = n.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def _check_sizes(max_chars: int, overlap: int, rows: int = 0) -> None:
    if max_chars < 256:
        raise ValueError("max_chars must be at least 256")
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must satisfy 0 <= overlap < max_chars")
    if rows < 0:
        raise ValueError("table overlap rows must be non-negative")


# --- tables ---------------------------------------------------------------------------------

def filled_grid(matrix: Column, merges: Column, limit: Column) -> Column:
    """Rows of (value, origin) with merged values spread over their span; later merges win."""
    columns = _span(F.coalesce(F.array_max(F.transform(matrix, F.size)), F.lit(0)))
    # Bound outside the rows, or the width of the whole matrix would be taken anew for each of them.
    plain = let(columns, lambda places: F.transform(F.slice(matrix, F.lit(1), F.greatest(limit, F.lit(0))), lambda row, r: F.transform(places, lambda c: let(
        clean(F.get(row, c)), lambda v: F.struct(v.alias("value"), F.when(
            v != "", F.concat(F.lit("R"), r.cast("string"), F.lit(":C"), c.cast("string"))).alias("origin"))))))

    def spread(grid: Column, m: Column) -> Column:
        row, column = F.coalesce(m["row"], F.lit(-1)), F.coalesce(m["column"], F.lit(-1))
        inside = (row >= 0) & (row < F.size(grid)) & (column >= 0) & (column < F.size(F.get(grid, 0)))
        origin = F.concat(F.lit("R"), row.cast("string"), F.lit(":C"), column.cast("string"))
        anchor = F.struct(F.get(F.get(grid, row), column)["value"].alias("value"), origin.alias("origin"))
        below = row + F.coalesce(m["row_span"], F.lit(1))
        beyond = column + F.coalesce(m["col_span"], F.lit(1))
        filled = F.transform(grid, lambda cells, r: F.when((r >= row) & (r < below), F.transform(
            cells, lambda cell, c: F.when((c >= column) & (c < beyond), anchor).otherwise(cell))).otherwise(cells))
        return F.when(inside, filled).otherwise(grid)

    return F.aggregate(_many(merges, f"array<{_MERGE}>"), plain, spread)


def _paths(grid: Column, columns: Column) -> Column:
    return let(grid, lambda rows: F.transform(_span(columns), lambda c: let(
        F.array_remove(F.transform(rows, lambda row: F.coalesce(F.get(row, c)["value"], F.lit(""))), ""), consecutive_distinct)))


def _cell_ids(grid: Column, columns: Column, table: Column) -> Column:
    return let(grid, lambda rows: F.transform(_span(columns), lambda c: F.array_distinct(F.array_compact(F.transform(
        rows, lambda row: F.concat(table, F.lit(":"), F.get(row, c)["origin"]))))))


def tables_of(docs: DataFrame) -> DataFrame:
    """One row per table with its own header paths and whether its logical group has a body."""
    tables = _many(F.col("semantic_elements.tables"), f"array<{_TABLE}>")
    logical = lambda t: F.coalesce(F.when(t["logical_table_id"] != "", t["logical_table_id"]), t["table_id"])
    with_body = F.array_distinct(F.transform(F.filter(
        tables, lambda t: F.coalesce(t["header_depth"], F.lit(0)) < F.coalesce(t["row_count"], F.lit(0))), logical))
    rows = docs.select("doc_id", with_body.alias("_bodies"), F.explode(tables).alias("t")).withColumn("logical_id", logical(F.col("t")))
    depth = F.coalesce("t.header_depth", F.lit(0))
    rows = rows.withColumns({
        "depth": depth, "stub": F.coalesce("t.stub_column_count", F.lit(0)), "columns": F.coalesce("t.column_count", F.lit(0)),
        "rows": F.coalesce("t.row_count", F.size("t.matrix")), "group_has_body": F.array_contains("_bodies", F.col("logical_id"))})
    rows = rows.withColumn("_head", filled_grid(F.col("t.matrix"), F.col("t.merge_evidence"), F.col("depth")))
    return rows.withColumns({
        "own_paths": _paths(F.col("_head"), F.col("columns")),
        "own_ids": _cell_ids(F.col("_head"), F.col("columns"), F.col("t.table_id"))}).drop("_head", "_bodies")


def with_inherited_headers(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds ``paths`` and ``path_ids``: headers of the source table first, then the own ones.

    With equal column counts the source headers are copied; otherwise the stub columns are
    kept and each parent column is repeated by its number of child columns, if that adds up.
    """
    links = docs.select("doc_id", F.posexplode("table_continuity").alias("at", "l")).where("l.status = 'CONFIRMED'").groupBy(
        "doc_id", F.col("l.to").alias("table_id")).agg(
        F.max_by("l.parent_child_mapping.successor_columns_per_parent", "at").alias("children"))
    source = tables.select("doc_id", F.col("t.table_id").alias("source_id"), F.col("own_paths").alias("s_paths"),
                           F.col("own_ids").alias("s_ids"), F.coalesce("t.stub_column_count", F.lit(1)).alias("s_stub"))
    joined = (
        tables.withColumns({"table_id": F.col("t.table_id"), "source_id": F.col("t.inherited_header.source_table_id")})
        .join(source, ["doc_id", "source_id"], "left").join(links, ["doc_id", "table_id"], "left")
    )
    empty = F.array().cast("array<string>")
    children = _many(F.col("children"), "array<int>")

    def expand(values: Column) -> Column:
        head = F.slice(values, F.lit(1), F.greatest(F.col("stub"), F.lit(0)))
        rest = F.flatten(F.transform(children, lambda n, i: F.array_repeat(F.coalesce(F.get(values, F.col("s_stub") + i), empty), n)))
        return F.concat(head, rest)

    blank = F.transform(_span(F.col("columns")), lambda c: empty)

    def inherited(name: str) -> Column:
        values = F.col(name)
        wide = expand(values)
        return (F.when(F.col("s_paths").isNull(), blank).when(F.size("s_paths") == F.col("columns"), values)
                .when(F.size(wide) == F.col("columns"), wide).otherwise(blank))

    joined = joined.withColumns({"_ip": inherited("s_paths"), "_ii": inherited("s_ids")})
    return joined.withColumns({
        "paths": F.zip_with("_ip", "own_paths", lambda a, b: let(F.array_remove(F.concat(a, b), ""), consecutive_distinct)),
        "path_ids": F.zip_with("_ii", "own_ids", lambda a, b: F.array_distinct(F.concat(a, b)))}).drop(
        "_ip", "_ii", "s_paths", "s_ids", "s_stub", "children", "source_id")


def table_context(table: Column) -> dict[str, Column]:
    """Title, titles, units (those of this table if any) and notes."""
    context, items = table["logical_context"], f"array<{_ITEM}>"
    some = lambda c: F.when(F.size(c) > 0, c)
    titles = F.coalesce(some(context["titles"]), F.when(table["title"].isNotNull(), F.array(table["title"])), F.array().cast(items))
    units = F.coalesce(some(context["units"]), table["units"], F.array().cast(items))
    notes = F.coalesce(some(context["notes"]), table["notes"], F.array().cast(items))
    local = F.filter(units, lambda u: u["source_table_id"] == table["table_id"])
    chosen = F.when(F.size(local) > 0, local).otherwise(units)
    return {
        "title": F.when(F.size(titles) > 0, clean(F.get(titles, 0)["text"])),
        "units": F.transform(chosen, lambda u, i: F.struct(
            F.concat(F.lit("u"), (i + 1).cast("string")).alias("unit_id"), clean(u["text"]).alias("text"), u["page"].alias("page"),
            F.lit("table").alias("scope"), u["source_table_id"].alias("source_table_id"),
            u["assignment_source"].alias("assignment_source"), u["confidence"].alias("confidence"))),
        "notes": F.filter(F.transform(notes, lambda n: F.struct(
            clean(n["text"]).alias("text"), n["page"].alias("page"), n["source_table_id"].alias("source_table_id"))), lambda n: n["text"] != ""),
    }


def column_labels(paths: Column, stub: Column) -> Column:
    return F.transform(paths, lambda p, c: F.when(F.size(p) > 0, F.array_join(p, " > ")).when(
        c < stub, F.when(stub == 1, STUB_LABEL).otherwise(F.concat(F.lit(STUB_LABEL + " "), (c + 1).cast("string")))
    ).otherwise(F.concat(F.lit(COLUMN_LABEL + " "), (c + 1).cast("string"))))


def table_windows(docs: DataFrame, max_chars: int = 4000, overlap_rows: int = 0) -> DataFrame:
    """One row per table chunk with everything the renderings need."""
    _check_sizes(max_chars, 0, overlap_rows)
    rows = with_inherited_headers(docs, tables_of(docs))
    body = F.transform(_span(F.col("rows") - F.col("depth")), lambda i: i + F.col("depth"))
    rows = rows.withColumn("_body", body).where((F.size("_body") > 0) | ~F.col("group_has_body"))
    costs = F.transform("_body", lambda r: F.aggregate(
        F.transform(F.get(F.col("t.matrix"), r), lambda v: F.length(clean(v)) + 3), F.lit(0), lambda a, b: a + b))
    rows = rows.withColumn("_costs", costs).withColumn("_w", pack_rows(max_chars, overlap_rows)("_costs"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop")))
    rows = rows.withColumn("_w", F.when(F.size("_w") > 0, F.col("_w")).otherwise(whole)).withColumn("part_count", F.size("_w"))
    rows = rows.select("*", F.posexplode("_w").alias("_n", "w")).withColumns({
        "part_index": F.col("_n") + 1, "row_indices": F.slice("_body", F.col("w.start") + 1, F.col("w.stop") - F.col("w.start"))})
    context = table_context(F.col("t"))
    rows = rows.withColumns({"title": context["title"], "units": context["units"], "notes": context["notes"],
                             "labels": column_labels(F.col("paths"), F.col("stub"))})
    table, page = F.col("t.table_id"), F.col("t.page")
    source, source_page = F.col("t.inherited_header.source_table_id"), F.col("t.inherited_header.source_page")
    rows = rows.withColumns({
        "kind": F.lit("table"),
        "chunk_id": F.concat(F.lit("CH_TABLE_"), table, F.lit("_"), _pad(F.col("part_index"), 3)),
        "sort_key": F.struct(page.alias("page"), F.get("t.bbox", 1).alias("y"), F.lit(1).alias("kind"), F.col("part_index").alias("part")),
        "pages": F.array_sort(F.array_distinct(F.array_compact(F.array(page, F.when(source_page != 0, source_page))))),
        "object_ids": F.array_distinct(F.array_compact(F.array(F.when(source != "", source), table))),
        "bboxes": F.array("t.bbox"), "section_path": F.array().cast("array<string>")})
    return rows.withColumn("plain", render_plain()).drop("_body", "_costs", "_w", "_n", "w")


def _cells(r: Column) -> Column:
    """Cleaned cells of matrix row ``r``, padded or cut to the number of labels."""
    return F.transform(_span(F.size("labels")), lambda c: clean(F.get(F.get(F.col("t.matrix"), r), c)))


def render_plain() -> Column:
    """Title, units, one ``label=value; ...`` line per row, notes."""
    lines = F.transform("row_indices", lambda r: F.array_join(F.filter(F.zip_with(
        "labels", _cells(r), lambda label, v: F.when(v != "", F.concat(label, F.lit("="), v))), lambda x: x.isNotNull()), "; "))
    head = F.array_compact(F.array(F.when(F.col("title") != "", F.col("title")), F.when(
        F.size("units") > 0, F.concat(F.lit(UNIT_LABEL), F.array_join("units.text", "; ")))))
    notes = F.transform("notes", lambda n: F.concat(F.lit(NOTE_LABEL), n["text"]))
    return F.array_join(F.concat(head, F.array_remove(lines, ""), notes), "\n")


def render_markdown() -> Column:
    rule = F.concat(F.lit("| "), F.array_join(F.transform("labels", lambda _, c: F.when(c < F.col("stub"), "---").otherwise("---:")), " | "), F.lit(" |"))
    body = F.transform("row_indices", lambda r: markdown_row(_cells(r)))
    return F.array_join(F.concat(F.array(markdown_row(F.col("labels")), rule), body), "\n")


def hierarchy() -> Column:
    """Columns, rows, cells (unpivoted measures) and merge spans of the chunk."""
    table, stub = F.col("t.table_id"), F.col("stub")
    columns = F.transform("paths", lambda p, c: F.struct(
        F.concat(F.lit("c"), c.cast("string")).alias("column_id"), c.alias("column_index"),
        F.when(c < stub, "row_dimension").otherwise("measure").alias("role"),
        F.when(F.size(p) > 0, p).otherwise(F.array(F.when(c < stub, STUB_LABEL).otherwise(
            F.concat(F.lit(COLUMN_LABEL + " "), (c + 1).cast("string"))))).alias("path"),
        F.get("path_ids", c).alias("source_cell_ids")))
    rows = let(F.col("grid"), lambda grid: F.transform("row_indices", lambda r: let(F.slice(F.get(grid, r), F.lit(1), F.greatest(stub, F.lit(0))), lambda head: F.struct(
        F.concat(F.lit("r"), r.cast("string")).alias("row_id"), r.alias("row_index"),
        let(let(F.array_remove(F.transform(head, lambda x: x["value"]), ""), consecutive_distinct), lambda p: F.when(F.size(p) > 0, p).otherwise(
            F.array(F.concat(F.lit(ROW_LABEL + " "), (r + 1).cast("string"))))).alias("path"),
        F.array_distinct(F.array_compact(F.transform(head, lambda x: F.concat(table, F.lit(":"), x["origin"])))).alias("source_cell_ids")))))
    measures = F.filter(_span(F.col("columns")), lambda c: c >= stub)
    cells = F.flatten(F.transform("row_indices", lambda r: F.transform(measures, lambda c: let(clean(F.get(F.get(F.col("t.matrix"), r), c)), lambda v: F.struct(
        F.concat(F.lit("r"), r.cast("string")).alias("row_id"), F.concat(F.lit("c"), c.cast("string")).alias("column_id"),
        v.alias("value"), content_type(v).alias("content_type"), F.col("units.unit_id").alias("unit_refs"),
        F.concat(table, F.lit(":R"), r.cast("string"), F.lit(":C"), c.cast("string")).alias("source_cell_id"))))))
    spans = F.transform(_many(F.col("t.merge_evidence"), f"array<{_MERGE}>"), lambda m: F.struct(
        table.alias("source_table_id"), F.coalesce(m["row"], F.lit(0)).alias("row"), F.coalesce(m["column"], F.lit(0)).alias("column"),
        F.coalesce(m["row_span"], F.lit(1)).alias("row_span"), F.coalesce(m["col_span"], F.lit(1)).alias("col_span")))
    return F.struct(columns.alias("columns"), rows.alias("rows"), cells.alias("cells"), spans.alias("spans"))


# --- records --------------------------------------------------------------------------------

def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _by_level(levels: tuple[int, ...], value) -> Column:
    """``value(level)`` of each row's own level."""
    out = value(levels[0])
    for level in levels[1:]:
        out = F.when(F.col("representation_level") == level, value(level)).otherwise(out)
    return out


def _text_records(rows: DataFrame, levels: tuple[int, ...], schema: tuple[str, str]) -> DataFrame:
    path = F.array_join("section_path", " > ")

    def document(level: int) -> Column:
        return F.col("plain") if level == 0 else _json(F.struct(
            *_payload_head(level, schema), F.struct("pages", "object_ids", "bboxes").alias("source"), "section_path",
            F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("content"))).alias("elements")))

    def active(level: int) -> Column:
        if level == 0:
            return F.col("plain")
        if level == 1:
            return F.array_join(F.array_compact(F.array(
                F.when(path != "", F.concat(F.lit("문서계층: "), path)), F.lit("내용:"), F.when(F.col("content") != "", F.col("content")))), "\n")
        numbered = F.transform("section_path", lambda p, i: F.concat(F.lit("계층 "), (i + 1).cast("string"), F.lit(": "), p))
        return F.array_join(F.concat(numbered, F.array(F.lit("본문:"), F.col("content"))), "\n")

    none = F.lit(None).cast("string")
    return rows.select(*_RECORD, none.alias("logical_table_id"), none.alias("physical_table_id"),
                       F.lit(None).cast("int").alias("part_index"), F.lit(None).cast("int").alias("part_count"),
                       _by_level(levels, document).alias("document"), _by_level(levels, active).alias("embedding_text"))


_RECORD = ["doc_id", "kind", "chunk_id", "sort_key", "pages", "object_ids", "section_path", "plain", "representation_level"]


def _payload_head(level: int, schema: tuple[str, str]) -> list[Column]:
    return [F.lit(schema[0]).alias("schema"), F.lit(schema[1]).alias("schema_version"), F.lit(level).alias("representation_level"),
            F.lit(LEVELS[level]).alias("representation_name"), F.col("chunk_id")]


def _table_records(rows: DataFrame, levels: tuple[int, ...], schema: tuple[str, str]) -> DataFrame:
    wanted = lambda low: F.col("representation_level") >= low
    if max(levels):
        rows = rows.withColumn("markdown", F.when(wanted(1), render_markdown()))
    if 2 in levels:
        grid = filled_grid(F.col("t.matrix"), F.col("t.merge_evidence"), F.size("t.matrix"))
        rows = rows.withColumn("grid", F.when(wanted(2), grid)).withColumn("h", F.when(wanted(2), hierarchy()))

    def document(level: int) -> Column:
        if level == 0:
            return F.col("plain")
        element = [
            F.lit("table").alias("type"), F.col("logical_id").alias("logical_table_id"), F.col("t.table_id").alias("physical_table_id"),
            F.struct("part_index", "part_count", F.col("depth").alias("header_depth"), F.col("stub").alias("stub_column_count")).alias("segment"),
            F.col("title"), F.struct(F.lit("markdown").alias("format"), F.col("markdown").alias("value")).alias("content"), F.col("units"), F.col("notes")]
        if level == 2:
            element.append(F.col("h").alias("hierarchy"))
        return _json(F.struct(
            *_payload_head(level, schema),
            F.struct("pages", "object_ids", "bboxes", F.col("logical_id").alias("logical_table_id")).alias("source"), "section_path",
            F.array(F.struct(*element)).alias("elements")))

    def active(level: int) -> Column:
        if level == 0:
            return F.col("plain")
        head = F.array_compact(F.array(
            F.when(F.col("title") != "", F.concat(F.lit("표제목: "), "title")),
            F.when(F.size("units") > 0, F.concat(F.lit(UNIT_LABEL), F.array_join("units.text", "; "))),
            F.concat(F.lit("논리표: "), "logical_id")))
        notes = F.transform("notes", lambda n: F.concat(F.lit(NOTE_LABEL), n["text"]))
        if level == 1:
            middle = F.array(F.lit("표내용:"), F.col("markdown"))
        else:
            # The cells lie row by row, so the place of a cell tells its row and column.
            first = F.greatest(F.col("stub"), F.lit(0))
            path_at = lambda entries, at: F.array_join(F.get(entries, at.cast("int"))["path"], " > ")
            middle = F.concat(
                F.transform("h.columns", lambda c: F.concat(F.lit("열계층["), c["column_id"], F.lit("]: "), F.array_join(c["path"], " > "))),
                F.transform("h.cells", lambda c, i: F.when(c["value"] != "", F.concat(
                    F.lit("셀: 행="), path_at(F.col("h.rows"), F.floor(i / (F.col("columns") - first))), F.lit("; 열="),
                    path_at(F.col("h.columns"), first + i % (F.col("columns") - first)), F.lit("; 값="), c["value"]))))
        return F.array_join(F.concat(head, middle, notes), "\n")

    return rows.select(*_RECORD, F.col("logical_id").alias("logical_table_id"), F.col("t.table_id").alias("physical_table_id"),
                       "part_index", "part_count", _by_level(levels, document).alias("document"), _by_level(levels, active).alias("embedding_text"))


def build_chunks(docs: DataFrame, level: int = 0, *, max_chars: int = 4000, overlap: int = 240, overlap_rows: int = 0,
                 schema: tuple[str, str] = ("semantic_chunk", "1.2")) -> DataFrame:
    """Chunk records of all documents at one representation level.

    Chunk ids and boundaries do not depend on the level; only the rendering does.
    """
    return level_matrix(docs, (level,), max_chars=max_chars, overlap=overlap, overlap_rows=overlap_rows, schema=schema)


def check_chunk_ids(chunks: DataFrame) -> DataFrame:
    require_unique(chunks, ["doc_id", "chunk_id"])
    return chunks


def level_matrix(docs: DataFrame, levels: tuple[int, ...] = (0, 1, 2), *, max_chars: int = 4000, overlap: int = 240, overlap_rows: int = 0,
                 schema: tuple[str, str] = ("semantic_chunk", "1.2")) -> DataFrame:
    """The same chunks at several levels; every level must hold the same ids.

    The windows are made once; each then parts into its levels, which differ only in the rendering.
    """
    for level in levels:
        if level not in LEVELS:
            raise ValueError(f"unknown representation level {level}")
    each = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels)))
    texts, tables = [rows.withColumn("representation_level", each) for rows in (
        text_windows(docs, max_chars, overlap), table_windows(docs, max_chars, overlap_rows))]
    chunks = _text_records(texts, levels, schema).unionByName(_table_records(tables, levels, schema))
    return chunks.withColumns({
        "representation_name": _by_level(levels, lambda level: F.lit(LEVELS[level])),
        "variant_id": F.concat("chunk_id", F.lit(":L"), F.col("representation_level").cast("string")),
        "embedding_profile": F.when(F.col("representation_level") == 0, "semantic_linearized").otherwise("experimental_representation"),
        "canonical_embedding_sha256": F.sha2("plain", 256), "canonical_embedding_chars": F.length("plain"),
        "active_embedding_chars": F.length("embedding_text")})


def level_counts(matrix: DataFrame) -> DataFrame:
    """The number of levels that hold a chunk."""
    return matrix.groupBy("doc_id", "chunk_id").agg(F.count_distinct("representation_level").alias("levels"))


def level_mismatches(matrix: DataFrame, levels: int) -> DataFrame:
    return level_counts(matrix).where(F.col("levels") != levels)

