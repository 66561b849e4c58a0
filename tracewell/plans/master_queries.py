"""The master-document family on documents built from the texts.

Every line of a text becomes a block, every fourth line a heading, and each document gets four
tables: one with merged headers, one that continues it, one with more columns linked to it, and one
with a row per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from tracewell.operators import master
from tracewell.plans.registry import Tables, query
from tracewell.plans.text_queries import sql_clean

WIDE = 1_000_000
ROWS, KEPT = 12, 2  # lines of the long table in one window of 256 characters, and those repeated in the next


def _text(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def _item(text: Column | str, table: str | None = None) -> Column:
    return F.struct(
        _text(text).alias("text"), F.lit(1).alias("page"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(table).alias("source_table_id"),
        F.lit(None).cast("string").alias("assignment_source"), F.lit(None).cast("double").alias("confidence"))


def _masters(t: Tables) -> DataFrame:
    d = t.spread("documents", "doc_id", "lang", "source", "n_chars", "text").withColumn("lines", F.split("text", "\n"))
    page = lambda i: (F.lit(1) + F.floor(i / 10)).cast("int")
    box = lambda i: F.array(F.lit(10.0), (i % 10 * 20).cast("double"), F.lit(100.0), (i % 10 * 20 + 10).cast("double"))
    named = lambda prefix, i: F.concat(F.lit(prefix), i.cast("string"))
    blocks = F.transform("lines", lambda x, i: F.struct(
        named("B", i).alias("object_id"), page(i).alias("page"), box(i).alias("bbox"), x.alias("text"), named("H", F.floor(i / 4)).alias("scope_heading_id")))
    last = F.size("lines") - 1
    heads = F.transform(F.sequence(F.lit(0), F.floor(last / 4)), lambda k: F.struct(
        named("H", k).alias("element_id"), F.when(k % 2 == 0, F.get("lines", (k * 4).cast("int"))).otherwise(named("part ", k)).alias("text"),
        F.when(k % 3 != 0, named("H", k - 1)).alias("parent_id"), page(k * 4).alias("page"), box(k * 4).alias("bbox")))
    furniture = F.transform(F.sequence(F.lit(0), F.floor(last / 10)), lambda p: F.struct(page(p * 10 + 9).alias("page"), box(p * 10 + 9).alias("bbox")))
    word = lambda n: F.coalesce(F.get(F.split(F.get("lines", 0), " "), n), F.lit(""))
    key = F.col("doc_id").cast("string")

    def merge(*numbers: int) -> Column:
        return F.struct(*[F.lit(n).alias(name) for n, name in zip(numbers, ("row", "column", "row_span", "col_span"))])

    def table(name: str, place: int, y: float, matrix: Column, depth: int, columns: int, rows: Column, merges: Column | None = None,
              source: str | None = None, logical: str = "L1") -> Column:
        none = F.array().cast(f"array<{master._MERGE}>")
        return F.struct(
            F.lit(name).alias("table_id"), F.lit(place).alias("page"), F.array(*[F.lit(v) for v in (10.0, y, 100.0, y + 20)]).alias("bbox"), matrix.alias("matrix"),
            (none if merges is None else merges).alias("merge_evidence"), F.lit(depth).alias("header_depth"), F.lit(1).alias("stub_column_count"),
            F.lit(columns).alias("column_count"), rows.alias("row_count"), F.lit(logical).alias("logical_table_id"),
            F.when(F.lit(source is not None), F.struct(F.lit(source).cast("string").alias("source_table_id"), F.lit(1).alias("source_page"))).alias("inherited_header"),
            F.when(F.lit(name == "T1"), _item(F.concat(F.lit("table of "), "source"))).alias("title"),
            F.array(_item("천원", "T1"), _item("other", "T9")).alias("units"), F.array(_item("note "), _item(" ")).alias("notes"),
            F.lit(None).cast(f"struct<titles:array<{master._ITEM}>,units:array<{master._ITEM}>,notes:array<{master._ITEM}>>").alias("logical_context"))

    row = lambda *cells: F.array(*[_text(c) for c in cells])
    first = F.array(row("kind", F.col("lang"), ""), row("", F.col("source"), F.col("n_chars").cast("string")), row(key, word(0), word(1)))
    long = F.transform("lines", lambda _, i: F.array(F.lpad(i.cast("string"), 6, "0"), F.col("lang"), F.lpad(key, 4, "0")))
    tables = F.array(
        table("T1", 1, 205.0, first, 2, 3, F.lit(3), F.array(merge(0, 1, 1, 2), merge(0, 0, 2, 1))),
        table("T2", 2, 5.0, F.array(row("total", "1", "-")), 0, 3, F.lit(1), source="T1"),
        table("T4", 3, 5.0, F.array(row("sum", "1", "2", "3")), 0, 4, F.lit(1), source="T1", logical="L4"),
        table("T5", 4, 5.0, long, 0, 3, F.size("lines"), logical="L5"))
    link = F.struct(F.lit("T4").alias("to"), F.lit("CONFIRMED").alias("status"),
                    F.struct(F.array(F.lit(2), F.lit(1)).alias("successor_columns_per_parent")).alias("parent_child_mapping"))
    area = F.struct(F.lit(1).alias("page"), F.array(*[F.lit(v) for v in (0.0, 55.0, 200.0, 75.0)]).alias("bbox"))
    return d.select(
        "doc_id", F.struct(blocks.alias("body_text"), furniture.alias("page_furniture")).alias("annotation"),
        F.struct(heads.alias("headings"), tables.alias("tables")).alias("semantic_elements"),
        F.struct(F.array(area).alias("physical_tables")).alias("raw_document"), F.array(link).alias("table_continuity"))


# Blocks that stay: not blank, not a page's last (furniture), not in the table's area, not a heading's own line.
SQL_BLOCKS = f"""
WITH l AS (SELECT doc_id, lang, source, n_chars, string_split(text, chr(10)) AS a FROM documents),
b AS (SELECT doc_id, i, {sql_clean('x')} AS line FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS i FROM l)),
k AS (SELECT * FROM b WHERE line <> '' AND i % 10 <> 9 AND i <> 3 AND i % 8 <> 0),
h AS (SELECT doc_id, i // 4 AS k, CASE WHEN (i // 4) % 2 = 0 THEN line ELSE 'part ' || i // 4 END AS title FROM b WHERE i % 4 = 0),
p AS (SELECT a.doc_id, a.k, coalesce(string_agg(u.title, chr(10) ORDER BY u.k) FILTER (WHERE u.title <> ''), '') AS path
   FROM h a JOIN h u ON u.doc_id = a.doc_id AND u.k BETWEEN a.k - a.k % 3 AND a.k GROUP BY ALL),
w AS (SELECT doc_id, i // 4 AS k, string_agg(line, chr(10) ORDER BY i) AS content, count(*) AS blocks, string_agg('B' || i, ',' ORDER BY i) AS object_ids FROM k GROUP BY ALL),
tw AS (SELECT w.*, path, 'CH_TEXT_' || lpad(CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY w.k) AS VARCHAR), 5, '0') AS chunk_id,
   CASE WHEN path = '' THEN content ELSE path || chr(10) || content END AS plain FROM w JOIN p USING (doc_id, k))"""

SQL_TABLES = f"""
g AS (SELECT doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n, {sql_clean("coalesce(string_split(a[1], ' ')[1], '')")} AS w1, {sql_clean("coalesce(string_split(a[1], ' ')[2], '')")} AS w2,
   len(a) AS lines FROM l),
tt AS (SELECT doc_id, range AS part, 10 * range AS first, least(10 * range + {ROWS}, lines) AS stop, lines, lang FROM g, range(0, 100000)
   WHERE range < greatest(1, 1 + ceil((lines - {ROWS}) / {ROWS - KEPT}.0)))"""


@query("body_blocks", SQL_BLOCKS + """
SELECT doc_id, count(*) AS n_blocks, string_agg('B' || i, ',' ORDER BY i) AS object_ids, sha256(string_agg(line, chr(10) ORDER BY i)) AS text_sha FROM k GROUP BY doc_id""")
def body_blocks(t: Tables):
    held = master.body_blocks(_masters(t)).where(F.size("blocks") > 0)
    return held.select("doc_id", F.size("blocks").alias("n_blocks"), F.array_join("blocks.object_id", ",").alias("object_ids"),
                       F.sha2(F.array_join("blocks.text", "\n"), 256).alias("text_sha"))


@query("master_text_windows", SQL_BLOCKS + " SELECT doc_id, chunk_id, blocks, object_ids, sha256(path) AS path_sha, sha256(plain) AS plain_sha FROM tw")
def master_text_windows(t: Tables):
    rows = master.text_windows(_masters(t), max_chars=WIDE, overlap=0)
    return rows.select("doc_id", "chunk_id", F.size("object_ids").alias("blocks"), F.array_join("object_ids", ",").alias("object_ids"),
                       F.sha2(F.array_join("section_path", "\n"), 256).alias("path_sha"), F.sha2("plain", 256).alias("plain_sha"))


@query("filled_grid", SQL_BLOCKS + f", {SQL_TABLES}" + """
SELECT doc_id, concat_ws('|', 'kind', lang, lang, 'kind', source, n, doc_id, w1, w2) AS grid,
  concat_ws('|', 'R0:C0', 'R0:C1', 'R0:C1', 'R0:C0', 'R1:C1', 'R1:C2', 'R2:C0', CASE WHEN w1 <> '' THEN 'R2:C1' ELSE '' END, CASE WHEN w2 <> '' THEN 'R2:C2' ELSE '' END) AS origins FROM g""")
def filled_grid(t: Tables):
    one = _masters(t).select("doc_id", F.get("semantic_elements.tables", 0).alias("t"))
    cells = F.flatten(master.filled_grid(F.col("t.matrix"), F.col("t.merge_evidence"), F.size("t.matrix")))
    return one.select("doc_id", cells.alias("c")).select("doc_id", F.array_join("c.value", "|").alias("grid"), F.array_join("c.origin", "|", "").alias("origins"))


@query("inherited_headers", SQL_BLOCKS + f", {SQL_TABLES}" + """
SELECT doc_id, unnest(['T1', 'T2', 'T4', 'T5']) AS table_id, unnest([a, a, b, '||']) AS paths FROM (
 SELECT doc_id, concat_ws('|', 'kind', CASE WHEN lang = source THEN lang ELSE lang || ' > ' || source END, lang || ' > ' || n) AS a,
   concat_ws('|', 'kind', lang || ' > ' || source, lang || ' > ' || source, lang || ' > ' || n) AS b FROM g)""")
def inherited_headers(t: Tables):
    docs = _masters(t)
    rows = master.with_inherited_headers(docs, master.tables_of(docs))
    return rows.select("doc_id", "table_id", F.array_join(F.transform("paths", lambda p: F.array_join(p, " > ")), "|").alias("paths"))


@query("master_table_windows", SQL_BLOCKS + f", {SQL_TABLES}" + """
SELECT doc_id, 'CH_TABLE_T5_' || lpad(CAST(part + 1 AS VARCHAR), 3, '0') AS chunk_id, part + 1 AS part_index, count(*) OVER (PARTITION BY doc_id) AS part_count, first AS first_row, stop - first AS n_rows FROM tt
UNION ALL SELECT doc_id, 'CH_TABLE_' || x || '_001', 1, 1, CASE WHEN x = 'T1' THEN 2 ELSE 0 END, 1 FROM g, (SELECT unnest(['T1', 'T2', 'T4']) AS x)""")
def master_table_windows(t: Tables):
    rows = master.table_windows(_masters(t), max_chars=256, overlap_rows=KEPT)
    return rows.select("doc_id", "chunk_id", "part_index", "part_count", F.get("row_indices", 0).alias("first_row"), F.size("row_indices").alias("n_rows"))


@query("hierarchy", SQL_BLOCKS + f", {SQL_TABLES}" + """,
c AS (SELECT doc_id, unnest([{'c': 'c1', 'v': w1, 'p': lang || ' > ' || source}, {'c': 'c2', 'v': w2, 'p': lang || ' > ' || n}], recursive := true) FROM g)
SELECT doc_id, 'r2' AS row_id, c AS column_id, v AS value, CAST(doc_id AS VARCHAR) AS row_path, p AS column_path, 'u1' AS unit_refs,
  CASE WHEN regexp_replace(v, '[, ]', '', 'g') = '' THEN 'empty' WHEN regexp_replace(v, '[, ]', '', 'g') IN ('-', '–', '—', 'N/A', 'n/a') THEN 'missing'
    WHEN regexp_full_match(regexp_replace(v, '[, ]', '', 'g'), '[+-]?(?:\\p{Nd}+(?:\\.\\p{Nd}+)?|\\.\\p{Nd}+)%?') THEN 'number' ELSE 'text' END AS content_type FROM c""")
def hierarchy(t: Tables):
    rows = master.table_windows(_masters(t), max_chars=WIDE).where("t.table_id = 'T1'")
    rows = rows.withColumn("grid", master.filled_grid(F.col("t.matrix"), F.col("t.merge_evidence"), F.size("t.matrix"))).withColumn("h", master.hierarchy())
    path = lambda side, key: F.array_join(F.get(F.filter(f"h.{side}", lambda e: e[key] == F.col(f"x.{key}")), 0)["path"], " > ")
    cells = rows.select("doc_id", "h", F.explode("h.cells").alias("x"))
    return cells.select("doc_id", "x.row_id", "x.column_id", "x.value", path("rows", "row_id").alias("row_path"), path("columns", "column_id").alias("column_path"),
                        F.array_join("x.unit_refs", ",").alias("unit_refs"), "x.content_type")


SQL_T1 = """
q AS (SELECT *, concat_ws('; ', 'kind=' || doc_id, CASE WHEN w1 <> '' THEN lang || ' > ' || source || '=' || w1 END, CASE WHEN w2 <> '' THEN lang || ' > ' || n || '=' || w2 END) AS line,
  '| kind | ' || lang || ' > ' || source || ' | ' || lang || ' > ' || n || ' |' || chr(10) || '| --- | ---: | ---: |' || chr(10)
   || '| ' || doc_id || ' | ' || replace(w1, '|', '\\|') || ' | ' || replace(w2, '|', '\\|') || ' |' AS md FROM g),
r AS (SELECT doc_id, concat_ws(chr(10), 'table of ' || source, '단위: 천원', line, '주석: note') AS l0,
  concat_ws(chr(10), '표제목: table of ' || source, '단위: 천원', '논리표: L1', '표내용:', md, '주석: note') AS l1,
  concat_ws(chr(10), '표제목: table of ' || source, '단위: 천원', '논리표: L1', '열계층[c0]: kind', '열계층[c1]: ' || lang || ' > ' || source, '열계층[c2]: ' || lang || ' > ' || n,
    CASE WHEN w1 <> '' THEN '셀: 행=' || doc_id || '; 열=' || lang || ' > ' || source || '; 값=' || w1 END,
    CASE WHEN w2 <> '' THEN '셀: 행=' || doc_id || '; 열=' || lang || ' > ' || n || '; 값=' || w2 END, '주석: note') AS l2 FROM q)"""


@query("render_levels", SQL_BLOCKS + f", {SQL_TABLES}, {SQL_T1}" + """
SELECT doc_id, unnest([0, 1, 2]) AS representation_level, sha256(unnest([l0, l1, l2])) AS text_sha, sha256(l0) AS canonical_sha, length(l0) AS canonical_chars FROM r""")
def render_levels(t: Tables):
    rows = master.level_matrix(_masters(t), max_chars=WIDE).where("chunk_id = 'CH_TABLE_T1_001'")
    return rows.select("doc_id", "representation_level", F.sha2("embedding_text", 256).alias("text_sha"),
                       F.col("canonical_embedding_sha256").alias("canonical_sha"), F.col("canonical_embedding_chars").alias("canonical_chars"))


@query("level_matrix", SQL_BLOCKS + f", {SQL_TABLES}" + """,
i AS (SELECT doc_id, chunk_id FROM tw UNION ALL SELECT doc_id, 'CH_TABLE_' || x || '_001' FROM g, (SELECT unnest(['T1', 'T2', 'T4', 'T5']) AS x))
SELECT doc_id, chunk_id, 3 AS levels, 0 AS mismatches FROM i""")
def level_matrix(t: Tables):
    counts = master.level_counts(master.level_matrix(_masters(t), max_chars=WIDE))
    return counts.select("doc_id", "chunk_id", F.col("levels").cast("int").alias("levels"), F.when(F.col("levels") != 3, 1).otherwise(0).alias("mismatches"))


@query("level_payload", SQL_BLOCKS + f", {SQL_TABLES}" + """
SELECT doc_id, chunk_id, 'semantic_chunk' AS schema, 1 AS level, CASE WHEN chunk_id LIKE 'CH_TEXT%' THEN 'text' ELSE 'table' END AS kind FROM (
 SELECT doc_id, chunk_id FROM tw UNION ALL SELECT doc_id, 'CH_TABLE_' || x || '_001' FROM g, (SELECT unnest(['T1', 'T2', 'T4', 'T5']) AS x))""")
def level_payload(t: Tables):
    rows = master.check_chunk_ids(master.build_chunks(_masters(t), 1, max_chars=WIDE))
    parsed = F.from_json("document", "schema string, representation_level int, chunk_id string, elements array<struct<type:string>>")
    return rows.select("doc_id", parsed.alias("p")).select("doc_id", "p.chunk_id", "p.schema", F.col("p.representation_level").alias("level"), F.get("p.elements", 0)["type"].alias("kind"))


@query("margin_blocks", SQL_BLOCKS + """
SELECT doc_id, count(*) FILTER (WHERE i % 10 * 20 + 10 <= 16 OR i % 10 * 20 >= 184) AS in_margin, count(*) AS blocks FROM b GROUP BY doc_id""")
def margin_blocks(t: Tables):
    blocks = _masters(t).select("doc_id", F.explode("annotation.body_text").alias("b"))
    return blocks.groupBy("doc_id").agg(F.count_if(master.in_margin(F.col("b.bbox"), F.lit(200))).alias("in_margin"), F.count(F.lit(1)).alias("blocks"))
