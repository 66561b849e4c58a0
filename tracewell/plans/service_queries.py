"""Uploads, index store, registry, validation and assembly over the given tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import spans, text
from tracewell.functions.money import rewrite_amounts
from tracewell.functions.vectors import hash_counts, window_encoder
from tracewell.operators import claims, evidence, fields, grouping, layout, prompts, reasoning, registry, retrieval, validation
from tracewell.operators.deletion import Deletion
from tracewell.operators.upload import process_uploads
from tracewell.plans.chunk_queries import OVERLAP, SIZE, SQL_SPLIT
from tracewell.plans.registry import Tables, query
from tracewell.plans.retrieval_queries import sql_counts, sql_fused
from tracewell.session import cut_lineage, shared_folder
from tracewell.sources import files, workbooks
from tracewell.sources.artifacts import ArtifactFolder
from tracewell.sources.embeddings import EmbeddingStore
from tracewell.sources.documents import template_sections as template_of
from tracewell.sources.index import ChunkIndex

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SQL_LINE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
META = {"representation_level": 0, "model_id": "hash", "model_sha256": "-", "dimension": 8}


def _line_id():
    return F.concat_ws("-", *LINE_KEYS)


# --- upload and index -------------------------------------------------------------------------

@query("upload_records", SQL_SPLIT + """,
pn AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS part_index, count(*) OVER (PARTITION BY doc_id) AS part_count FROM p WHERE piece <> ''),
pc AS (SELECT *, 'CH_POC_' || lpad(CAST(part_index AS VARCHAR), 5, '0') AS chunk_id FROM pn)
SELECT doc_id, chunk_id, part_index, part_count, sha256(piece) AS text_sha,
  'GCH_' || sha256(lang || chr(31) || source || chr(31) || doc_id || chr(31) || chunk_id || chr(31) || '0') AS global_chunk_id FROM pc JOIN documents USING (doc_id)""")
def upload_records(t: Tables):
    docs = t.spread("documents", "doc_id", "lang", "source", "text").withColumn("document_id", F.col("doc_id").cast("string"))
    rows = registry.upload_records(docs, spans.char_split(SIZE, OVERLAP)("text"), tenant="lang", case="source")
    return rows.select("doc_id", "chunk_id", "part_index", "part_count", F.sha2("embedding_text", 256).alias("text_sha"), "global_chunk_id")


def _index(t: Tables) -> tuple[ChunkIndex, DataFrame]:
    chunks = t.spread("documents").select(
        F.col("lang").alias("tenant_id"), F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("1").alias("chunk_id"),
        F.col("text").alias("embedding_text"), hash_counts("text").alias("vector"), F.split("text", " ").alias("words"))
    return ChunkIndex(t.spark, f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}", buckets=2), chunks


@query("index_search", sql_fused("WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src2', 'src3')", "").replace(
    "SELECT item_id AS query_id, rank, doc_id, round(score, 9) AS score, round(dense, 6) AS dense_score, round(lexical, 6) AS lexical_score, dense_rank, lexical_rank",
    "SELECT item_id AS query_id, rank, round(score, 9) AS score"))
def index_search(t: Tables):
    index, chunks = _index(t)
    index.create(chunks, META)
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text", hash_counts("text").alias("vector"))
    hits = index.search(queries, {"tenant_id": ["fr", "de"], "case_id": ["src1", "src2", "src3"]}, k=5)
    # Equal texts of several documents share their scores, so the ids themselves are not compared.
    return hits.select("query_id", "rank", F.round("score", 9).alias("score"))


@query("index_store", """
WITH k AS (SELECT lang, source, doc_id, CASE WHEN doc_id % 10 = 3 THEN 'new ' || text ELSE text END AS x FROM documents WHERE NOT (lang = 'es' AND source = 'src2'))
SELECT lang AS tenant_id, source AS case_id, CAST(doc_id AS VARCHAR) AS document_id, count(*) AS records, sum(length(x)) AS characters FROM k GROUP BY ALL""")
def index_store(t: Tables):
    index, chunks = _index(t)
    index.create(chunks, META)
    index.upsert(chunks.where("cast(document_id AS long) % 10 = 3").withColumn("embedding_text", F.concat(F.lit("new "), "embedding_text")), META)
    index.delete(tenant_id="es", case_id="src2")
    return index.read().groupBy("tenant_id", "case_id", "document_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("embedding_text")).alias("characters"))


@query("coalesced_blocks", """
WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
n AS (SELECT *, 1 + i // 10 AS page, i % 10 // 5 AS half, i - row_number() OVER (PARTITION BY doc_id, i // 5 ORDER BY i) AS run FROM b WHERE trim(line) <> '')
SELECT doc_id, page, min(i) AS position, count(*) AS blocks, sha256(string_agg(line, chr(10) ORDER BY i)) AS text_sha,
  CASE WHEN count(*) = 1 THEN 'b' || min(i) ELSE 'b' || min(i) || '..b' || max(i) END AS location,
  min(i % 10 * 20 + half * 100)::DOUBLE AS top, max(i % 10 * 20 + half * 100 + 10)::DOUBLE AS bottom FROM n GROUP BY doc_id, page, half, run""")
def coalesced_blocks(t: Tables):
    lines = t.spread("documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text")).where("trim(text) <> ''")
    top = (F.col("position") % 10 * 20 + F.floor(F.col("position") % 10 / 5) * 100).cast("double")
    blocks = lines.select("doc_id", (F.lit(1) + F.floor(F.col("position") / 10)).cast("int").alias("page"), "position", "text",
                          F.array(F.lit(10.0), top, F.lit(100.0), top + 10).alias("bbox"), F.concat(F.lit("b"), F.col("position").cast("string")).alias("location"))
    found = layout.coalesce_blocks(blocks, "doc_id", max_chars=1_000_000)
    return found.select("doc_id", "page", "position", F.size("source_spans").alias("blocks"), F.sha2("text", 256).alias("text_sha"), "location",
                        F.get("bbox", 1).alias("top"), F.get("bbox", 3).alias("bottom"))


# --- registry ---------------------------------------------------------------------------------

@query("audit_log", """
WITH e AS (SELECT event_id AS source_id, user_id, event_type, '{"source_id":' || event_id || ',"user_id":' || user_id || '}' AS payload_json FROM events)
SELECT 'AUD_' || substr(sha256(user_id || chr(31) || event_type || chr(31) || source_id || chr(31) || payload_json), 1, 20) AS event_id, user_id AS entity_id, event_type, payload_json FROM e""")
def audit_log(t: Tables):
    changes = t.events.withColumnRenamed("event_id", "source_id")
    path = f"{shared_folder(t.spark)}/audit-{uuid.uuid4().hex}"
    for half in (0, 1, 1):  # the last batch is written again, as after a failure
        rows = registry.audit_events(changes.where(F.col("source_id") % 2 == half), "user_id", "event_type", ["source_id", "user_id"], at="source_id")
        registry.append_audit(rows, path, f"half-{half}")
    return registry.read_audit(t.spark, path).drop("created_at")


@query("case_purge_all", """
WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'orders' AS name, count(*) FILTER (WHERE o_custkey NOT IN (FROM g)) AS kept, count(*) FILTER (WHERE o_custkey IN (FROM g)) AS removed FROM orders
UNION ALL SELECT 'events', count(*) FILTER (WHERE user_id NOT IN (FROM g)), count(*) FILTER (WHERE user_id IN (FROM g)) FROM events
UNION ALL SELECT 'customer', count(*) FILTER (WHERE c_acctbal >= 0), count(*) FILTER (WHERE c_acctbal < 0) FROM customer""")
def case_purge_all(t: Tables):
    tables = {"orders": t.orders.withColumnRenamed("o_custkey", "case_id"), "events": t.events.withColumnRenamed("user_id", "case_id"),
              "customer": t.customer.withColumnRenamed("c_custkey", "case_id")}
    return registry.purge_counts(tables, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("case_id")), ["case_id"])


@query("listing_by_kind", """
SELECT o_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '') AS credit_reports,
  coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), '') AS attachments FROM orders GROUP BY o_custkey""")
def listing_by_kind(t: Tables):
    docs = t.orders.withColumn("kind", F.when(F.col("o_orderstatus") == "F", "credit_report").otherwise("attachment"))
    found = registry.listing_by_kind(docs, ["o_custkey"], "kind", "o_orderkey", ["o_orderdate"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("o_custkey", joined("credit_reports"), joined("attachments"))


# --- evidence and validation ------------------------------------------------------------------

@query("money_rewrite", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'sales ' || q || '백만원, loss -' || q || '백만원, ' || q || '원화' AS said
FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""")
def money_rewrite(t: Tables):
    q = F.col("l_quantity").cast("int").cast("string")
    said = F.concat(F.lit("sales "), q, F.lit(",000천원, loss ("), q, F.lit(") 백만원, "), q, F.lit("원화"))
    return t.spread("lineitem").select(*LINE_KEYS, rewrite_amounts(said).alias("said"))


@query("placeholders", """
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'keep ' || o_orderpriority || chr(10) || 'end' ELSE 'only ' || o_orderstatus END AS said FROM orders""")
def placeholders(t: Tables):
    many = F.concat(F.lit("keep "), "o_orderpriority", F.lit("\n[DATE] drop [value]\nend\n"))
    said = F.when(F.col("o_custkey") % 2 == 0, many).otherwise(F.concat(F.lit(" [COMPANY] only "), "o_orderstatus"))
    return t.orders.select("o_orderkey", text.strip_placeholders(said).alias("said"))


@query("evidence_assembly", """
WITH f AS (SELECT *, unnest(CASE WHEN p_size % 5 = 0 THEN ['A', 'B', 'C', 'D', 'E'] WHEN p_size % 5 = 1 THEN ['A', 'C'] ELSE ['B'] END) AS item FROM part),
h AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'D' END AS item FROM documents)
SELECT 'CR_' || substr(sha256(item || chr(31) || p_partkey), 1, 20) AS evidence_id, item AS review_item, CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS source_tier,
  'credit_report' AS source_class, sha256(p_brand || '=' || format('{:,}', p_size * 100) || '; 단위=백만원; 기간=2024') AS content_sha FROM f
UNION ALL SELECT 'ATT_' || substr(sha256(item || chr(31) || 'G' || doc_id), 1, 20), item, 3, 'attachment', sha256(text) FROM h""")
def evidence_assembly(t: Tables):
    size = F.col("p_size")
    facts = t.part.select(
        F.col("p_partkey").cast("string").alias("fact_id"), F.col("p_brand").alias("field_name"), size.cast("string").alias("value"), F.lit("억원").alias("unit"), F.lit("2024").alias("period"),
        F.when(size % 5 == 0, F.array().cast("array<string>")).when(size % 5 == 1, F.array(F.lit("A"), F.lit("C"), F.lit("A"))).otherwise(F.array(F.lit("B"), F.lit("Z"))).alias("review_items"),
        (size % 5 == 0).alias("common"), F.lit("d").alias("document_id"), F.lit("f").alias("source_filename"), F.lit("s").alias("sheet_name"), F.lit("B2").alias("cell_range"))
    hits = t.documents.select(
        F.when(F.col("doc_id") % 2 == 0, "A").otherwise("D").alias("review_item"), F.concat(F.lit("G"), F.col("doc_id").cast("string")).alias("global_chunk_id"),
        F.col("text").alias("document"), F.col("source").alias("document_id"), F.col("source").alias("source_filename"), F.array(F.lit(1)).alias("pages"), F.lit(0.5).alias("score"))
    rows = evidence.assemble(facts, hits)
    return rows.select("evidence_id", "review_item", "source_tier", "source_class", F.sha2("content", 256).alias("content_sha"))


SQL_SECTIONS = """
WITH s AS (SELECT o_orderkey, o_custkey % 4 AS kind, o_custkey + 100 AS n FROM orders)"""


def _sections(t: Tables) -> tuple[DataFrame, DataFrame]:
    n, kind = F.col("o_custkey") + 100, F.col("o_custkey") % 4
    cite = F.concat(F.lit("CR_"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 20))
    said = lambda x: F.concat(F.lit("The size is "), x.cast("string"), F.lit("백만원"))
    told = F.when(kind == 0, F.concat(said(n), F.lit(". ["), cite, F.lit("]"))).when(kind == 1, F.concat(said(n), F.lit("."))).when(
        kind == 2, F.concat(said(n + 1), F.lit(" ["), cite, F.lit("]."))).otherwise(F.concat(F.lit("No figure at all ["), cite, F.lit("].")))
    sections = t.orders.select(F.col("o_orderkey").alias("section"), told.alias("text"))
    known = t.orders.select(F.col("o_orderkey").alias("section"), cite.alias("evidence_id"), F.concat(F.lit("금액="), n.cast("string"), F.lit("; 단위=백만원")).alias("content"))
    return sections, known


@query("section_issues", SQL_SECTIONS + """
SELECT o_orderkey AS section, 'missing_evidence_citation' AS code, '' AS detail, 'ERROR' AS severity FROM s WHERE kind = 1
UNION ALL SELECT o_orderkey, 'numeric_claim_without_citation', n || '백만원', 'ERROR' FROM s WHERE kind = 1
UNION ALL SELECT o_orderkey, 'unsupported_numeric_fact', (n + 1) || '백만원', 'ERROR' FROM s WHERE kind = 2""")
def section_issues(t: Tables):
    return validation.validate_sections(*_sections(t))


@query("section_leaks", """
WITH s AS (SELECT o_orderkey, o_custkey % 3 AS kind, o_custkey + 100 AS n, o_custkey % 5 = 0 AS agrees FROM orders)
SELECT o_orderkey AS section, 'credit_report_direct_conflict' AS code, n || '백만원' AS detail, 'ERROR' AS severity FROM s WHERE kind = 0 AND NOT agrees
UNION ALL SELECT o_orderkey, 'unsupported_numeric_fact', '77%%', 'ERROR' FROM s WHERE kind = 1
UNION ALL SELECT o_orderkey, 'few_shot_numeric_leakage', '77%%', 'ERROR' FROM s WHERE kind = 1
UNION ALL SELECT o_orderkey, 'few_shot_token_leakage', 'Acme Corp', 'ERROR' FROM s WHERE kind = 2 AND NOT agrees""")
def section_leaks(t: Tables):
    """Attachments against the credit report, numbers and names of the style examples: the codes that need more than evidence.

    A percentage is shown as it stands and with its unit, so its sign comes twice.
    """
    kind, n, agrees = F.col("o_custkey") % 3, F.col("o_custkey") + 100, F.col("o_custkey") % 5 == 0
    digest = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 20)
    att, credit = F.concat(F.lit("ATT_"), digest), F.concat(F.lit("CR_"), digest)
    amount = lambda x: F.concat(F.lit("금액="), x.cast("string"), F.lit("; 단위=백만원")).alias("content")
    said = F.when(kind == 0, F.concat(F.lit("The size is "), n.cast("string"), F.lit("백만원 ["), att, F.lit("]."))).when(
        kind == 1, F.concat(F.lit("The rate is 77% ["), att, F.lit("]."))).otherwise(F.concat(F.lit("Acme Corp does well ["), att, F.lit("].")))
    base = t.orders.select(F.col("o_orderkey").alias("section"), "*")
    sections = base.select("section", said.alias("text"))
    own = F.when((kind == 2) & agrees, F.lit("Acme Corp is named")).otherwise(amount(n))
    evidence = base.select("section", att.alias("evidence_id"), own.alias("content")).unionByName(
        base.select("section", credit.alias("evidence_id"), amount(F.when(agrees, n).otherwise(n + 1))))
    examples = base.select("section", F.lit("Once it was 77%.").alias("output_example"), F.array(F.lit("Acme Corp"), F.lit("")).alias("forbidden_tokens"))
    conflicts = base.select("section", att.alias("evidence_id"), credit.alias("credit_id"))
    return validation.validate_sections(sections, evidence, examples, conflicts)


# --- files ------------------------------------------------------------------------------------

@F.arrow_udf(T.BinaryType())
def _docx_of(texts: pa.Array) -> pa.Array:
    """A document package with a paragraph for every line and a table of one row with the first two words."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    found = []
    for text in texts.to_pylist():
        run = lambda x: f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
        cells = "".join(f"<w:tc>{run(x)}</w:tc>" for x in (text.split(" ") + ["", ""])[:2])
        body = "".join(map(run, text.split("\n"))) + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as package:
            package.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        found.append(out.getvalue())
    return pa.array(found, pa.binary())


@query("docx_blocks", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
w AS (SELECT doc_id, list_resize(string_split(text, ' '), 2, '')[1:2] AS w FROM documents),
c AS (SELECT doc_id, list_transform(w, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS c FROM w)
SELECT doc_id, 'paragraph:' || n AS location, sha256(trim(line, ' ' || chr(9) || chr(13))) AS text_sha FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
UNION ALL SELECT doc_id, 'table:1:row:1', sha256(c[1] || ' | ' || c[2]) FROM c WHERE c[1] <> '' OR c[2] <> ''""")
def docx_blocks(t: Tables):
    packages = t.spread("documents", "doc_id", "text").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), _docx_of("text").alias("content"))
    blocks = files.extract_blocks(packages)
    return blocks.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), "location", F.sha2("text", 256).alias("text_sha"))


@F.arrow_udf(T.BinaryType())
def _xlsx_of(rows: pa.Array) -> pa.Array:
    """A workbook with one sheet: columns A (number), B (text) and C (a formula with its value) for every row."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    blank, found = io.BytesIO(), []
    with zipfile.ZipFile(blank, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
    for lines in rows.to_pylist():
        body = "".join(f'<row><c r="A{k}"><v>{x["a"]}</v></c><c r="B{k}" t="inlineStr"><is><t>{escape(x["b"])}</t></is></c><c r="C{k}"><f>A{k}*2</f><v>{2 * x["a"]}</v></c></row>'
                       for k, x in enumerate(lines, 1))
        out = io.BytesIO()
        out.write(blank.getbuffer())
        with zipfile.ZipFile(out, "a") as book:
            book.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        found.append(out.getvalue())
    return pa.array(found, pa.binary())


def _books(t: Tables) -> DataFrame:
    """One workbook of each order's lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("a"), F.col("l_returnflag").alias("b"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    return rows.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".xlsx")).alias("path"), _xlsx_of(F.transform("rows", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))).alias("content"))


SQL_BOOKS = """
WITH r AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS a, l_returnflag AS b,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER), l_returnflag) AS k FROM lineitem)"""


@query("xlsx_rows", SQL_BOOKS + """
SELECT l_orderkey, 'sheet:S:row:' || k AS location, '시트=S; A' || k || '=' || a || '; B' || k || '=' || b || '; C' || k || '==A' || k || '*2' AS text FROM r""")
def xlsx_rows(t: Tables):
    blocks = files.extract_blocks(_books(t))
    return blocks.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("l_orderkey"), "location", "text")


@query("mapped_workbooks", SQL_BOOKS + """
SELECT l_orderkey, 'size:A' || k AS field_id, CAST(a AS VARCHAR) AS value, '백만원' AS unit, NULL AS formula FROM r WHERE k <= 3
UNION ALL SELECT l_orderkey, 'twice', CAST(2 * a AS VARCHAR), (SELECT b FROM r x WHERE x.l_orderkey = r.l_orderkey AND x.k = 1), '=A1*2' FROM r WHERE k = 1""")
def mapped_workbooks(t: Tables):
    mapping = t.spark.createDataFrame([("size", "크기", "S", "A1:A3", ["A"], False, "백만원", None, None, None), ("twice", "두배", "S", "C1", ["B"], False, None, "B1", None, None)], workbooks.MAPPING)
    facts = workbooks.mapped_facts(files.read_cells(_books(t)), mapping, (F.lit("t"), F.lit("c"), F.col("path")), F.col("path"))
    return facts.select(F.regexp_extract("source_filename", "([0-9]+)", 1).cast("long").alias("l_orderkey"), "field_id", "value", "unit", "formula")


@query("cross_section", """
WITH s AS (SELECT o_custkey, o_orderstatus AS item, strftime(o_orderdate, '%Y') AS y, CAST(100 + o_orderkey % 3 AS VARCHAR) AS v FROM orders)
SELECT o_custkey, y AS period, min(v) AS low, max(v) AS high, count(*) AS claims FROM s GROUP BY ALL HAVING min(v) <> max(v) AND min(item) <> max(item)""")
def cross_section(t: Tables):
    said = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("년 매출액 "), (F.col("o_orderkey") % 3 + 100).cast("string"), F.lit("백만원."))
    rows = t.orders.select(F.col("o_custkey").alias("case"), F.col("o_orderstatus").alias("item"), said.alias("text"))
    found = validation.cross_section_conflicts(rows)
    return found.select(F.col("case").alias("o_custkey"), F.array_join("periods", ",").alias("period"), "low", "high", "claims")


@query("accept_issues", """
SELECT o_orderkey, 1 AS rank, 'big ' || o_orderstatus AS title, 'HIGH' AS materiality, 'E1' AS evidence_ids FROM orders WHERE o_custkey % 2 = 0""")
def accept_issues(t: Tables):
    issues = F.concat(F.lit('note ```{"items":{"A":{"judgment_focus":"f","priority_issues":[{"title":"unknown id","materiality":"HIGH","evidence_ids":["Z"]},'
                            '{"title":"small","materiality":"LOW","evidence_ids":["E1"]},{"title":"big '), "o_orderstatus",
                      F.lit('","materiality":"high","evidence_ids":["Z","E1"]}]},"Q":{"priority_issues":[]}}}``` end'))
    replies = t.orders.select(F.col("o_orderkey").alias("case"), issues.alias("reply"))
    known = t.orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("case"), F.lit("A").alias("review_item"), F.lit("E1").alias("evidence_id"))
    found = reasoning.accept_issues(replies, known)
    return found.select(F.col("case").alias("o_orderkey"), "rank", "title", "materiality", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("template_sections", f"""
WITH e AS (SELECT l_orderkey, {SQL_LINE_ID} AS id, l_partkey, l_returnflag = 'R' AND l_linestatus = 'O' AS risky FROM lineitem),
b AS (SELECT *, bool_and(risky) OVER (PARTITION BY l_orderkey) AS all_risky FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY id) AS n FROM b WHERE all_risky OR NOT risky)
SELECT l_orderkey, '확인된 근거자료상 ' || string_agg('part ' || l_partkey || ' [' || id || ']', ' ' ORDER BY n) AS said FROM r WHERE n <= 3 GROUP BY l_orderkey""")
def template_sections(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("section"), _line_id().alias("evidence_id"), F.when(F.col("l_returnflag") == "R", "attachment").otherwise("credit_report").alias("source_class"),
        (F.col("l_linestatus") == "O").alias("in_conflict"), F.concat(F.lit(" part  "), F.col("l_partkey").cast("string")).alias("content"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy("evidence_id")))
    return template_of(ranked).select(F.col("section").alias("l_orderkey"), F.col("text").alias("said"))


@query("original_evidence", f"""
SELECT {SQL_LINE_ID} AS evidence_id, 'part ' || l_partkey || ' of ' || l_suppkey AS content FROM lineitem WHERE l_returnflag = 'R'""")
def original_evidence(t: Tables):
    rows = t.lineitem.select("l_orderkey", _line_id().alias("evidence_id"), F.concat(
        F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string")).alias("content"))
    shown = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", _line_id().alias("evidence_id"), F.lit("part ...").alias("content"))
    return registry.original_rows(shown, rows, ["l_orderkey"]).select("evidence_id", "content")


# --- flows ------------------------------------------------------------------------------------

@query("upload_flow", SQL_SPLIT + """,
u AS (SELECT doc_id, count(*) AS chunks FROM p WHERE piece <> '' GROUP BY doc_id)
SELECT 'd' || doc_id || CASE WHEN doc_id % 9 = 4 THEN '.exe' ELSE '.txt' END AS path, CASE WHEN doc_id % 9 = 4 THEN 'EXCLUDED' ELSE 'READY' END AS status,
  CASE WHEN doc_id % 9 = 4 THEN 'ValueError: unsupported attachment type: .exe' END AS error, CASE WHEN doc_id % 9 = 4 THEN 0 ELSE chunks END AS chunks FROM documents JOIN u USING (doc_id)""")
def upload_flow(t: Tables):
    files = t.spread("documents", "doc_id", "text").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 4, ".exe").otherwise(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return process_uploads(files, tenant="t", case="c", size=SIZE, overlap=OVERLAP)[1]


class _FailsOnce(ArtifactFolder):
    """A file store that cannot be reached at first."""

    failed = False

    def delete(self, scope):
        if not self.failed:
            self.failed = True
            raise OSError("file store is away")
        return super().delete(scope)


@query("delete_lifecycle", """
WITH d AS (SELECT count(*) AS n FROM documents WHERE lang = 'de' AND source = 'src1')
SELECT 1 AS run, 'DELETING' AS status, n AS chunks, NULL AS error FROM d UNION ALL SELECT 1, 'VECTORS', n, NULL FROM d UNION ALL SELECT 1, 'VERIFIED', 0, NULL
UNION ALL SELECT 1, 'FAILED', 0, 'file store is away' UNION ALL SELECT 2, 'VERIFIED', 0, NULL UNION ALL SELECT 2, 'ARTIFACTS', 0, NULL UNION ALL SELECT 2, 'DELETED', 0, NULL
UNION ALL SELECT 3, 'DELETED', 0, 'no file left'""")
def delete_lifecycle(t: Tables):
    index, chunks = _index(t)
    index.create(chunks, META)
    scope = {"tenant_id": "de", "case_id": "src1"}
    files = _FailsOnce(t.spark, f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}")
    t.documents.where("lang = 'de' AND source = 'src1'").select("text").write.text(files.place(scope))
    deletion = Deletion(index, files, f"{shared_folder(t.spark)}/deletions-{uuid.uuid4().hex}")
    for _ in range(3):
        last = deletion.run(**scope)
    log = deletion.history(scope).select("run", "status", "chunks", "error")
    return log.unionByName(t.spark.createDataFrame([(3, last, index.count(scope), "files left" if files.present(scope) else "no file left")], log.schema))


@query("corrupt_index", """
SELECT lang AS tenant_id, source AS case_id, CASE WHEN lang = 'de' AND source = 'src1' THEN 'missing,unknown' ELSE 'ok' END AS said FROM (SELECT DISTINCT lang, source FROM documents)""")
def corrupt_index(t: Tables):
    """What the manifest says of every case after the files of one were replaced behind it."""
    index, chunks = _index(t)
    index.create(chunks, META)
    near = cut_lineage(index.read({"tenant_id": "de", "case_id": "src1"}))
    near.withColumn("embedding_text", F.concat(F.col("embedding_text"), F.lit("!"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "tenant_id", "case_id", "bucket").parquet(f"{index.path}/data")
    t.spark.catalog.refreshByPath(f"{index.path}/data")
    wrong = index.corrupt_files().groupBy("tenant_id", "case_id").agg(F.array_join(F.array_sort(F.collect_set("said")), ",").alias("said"))
    cases = index.read().select("tenant_id", "case_id").distinct()
    return cases.join(wrong, ["tenant_id", "case_id"], "left").select("tenant_id", "case_id", F.coalesce("said", F.lit("ok")).alias("said"))


@query("embedding_store", sql_counts("dv", "documents", "doc_id").join(["WITH ", """,
n AS (SELECT doc_id, count(*) AS buckets, max(n) AS largest FROM dv GROUP BY doc_id)
SELECT d.doc_id, coalesce(buckets, 0) AS buckets, coalesce(largest, 0) AS largest,
  (SELECT count(DISTINCT text) FROM documents) AS stored FROM documents d LEFT JOIN n USING (doc_id)"""]))
def embedding_store(t: Tables):
    """Half of the documents are encoded, then all: only new contents are, and each once."""
    name = f"embeddings_{uuid.uuid4().hex}"
    store = EmbeddingStore(t.spark, name, f"{shared_folder(t.spark)}/{name}", buckets=8)
    docs = t.documents.select("doc_id", "text")
    for part in (docs.where("doc_id % 2 = 0"), docs):
        store.add(part, "text", "hash-8", hash_counts)
    stored = store.rows().count()
    found = store.vectors(docs, "text", "hash-8", "doc_id")
    own = F.filter("vector", lambda x: x > 0)
    return found.select("doc_id", F.size(own).cast("long").alias("buckets"), F.coalesce(F.array_max(own).cast("long"), F.lit(0)).alias("largest"), F.lit(stored).alias("stored"))


@query("pooled_encode", """
WITH w AS (SELECT doc_id, i, substr(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS piece FROM documents, range(0, 100000) r(i) WHERE i * 900 < greatest(length(text) - 100, 1)),
c AS (SELECT doc_id, i, unnest(string_split(piece, '')) AS ch, generate_subscripts(string_split(piece, ''), 1) - 1 AS k FROM w),
b AS (SELECT doc_id, (unicode(ch) + k) % 8 AS dim, count(*) AS n FROM c GROUP BY ALL), n AS (SELECT doc_id, count(*) AS windows FROM w GROUP BY ALL),
m AS (SELECT doc_id, dim, n / windows AS m FROM b JOIN n USING (doc_id)), z AS (SELECT doc_id, sqrt(sum(m * m)) AS z, max(m) AS top, sum(m) AS total FROM m GROUP BY ALL)
SELECT doc_id, round(total, 6) AS total, round(top / z, 6) AS largest FROM z""")
def pooled_encode(t: Tables):
    found = retrieval.pooled_vectors(t.spread("documents", "doc_id", "text"), "doc_id", "text", hash_counts)
    return found.select("doc_id", F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("unit"), 6).alias("largest"))


def _word_model():
    """Words as tokens, the bucket of a word's first letter and length as its hidden state."""
    def tokens(said: str) -> list[int]:
        return [(ord(w[0]) + len(w)) % 8 for w in said.split(" ") if w]

    return tokens, lambda ids, mask: np.eye(8)[ids]


@query("window_encode", """
WITH d AS (SELECT doc_id, list_transform(list_filter(string_split('passage: ' || text, ' '), lambda w: w <> ''), lambda w: (unicode(w) + length(w)) % 8) AS k FROM documents),
w AS (SELECT doc_id, i, k[i * 56 + 1:i * 56 + 64] AS part FROM (SELECT doc_id, k, unnest(range(0, greatest(1, (len(k) - 8 + 55) // 56))) AS i FROM d)),
c AS (SELECT doc_id, i, b, len(list_filter(part, lambda x: x = b)) / len(part) AS x FROM w, range(8) r(b)),
u AS (SELECT doc_id, i, b, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, i)) AS x FROM c), m AS (SELECT doc_id, b, avg(x) AS x FROM u GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n, max(x) AS top, sum(x) AS total FROM m GROUP BY ALL)
SELECT doc_id, round(top / n, 4) AS largest, round(total / n, 4) AS total FROM n""")
def window_encode(t: Tables):
    encode = window_encoder(_word_model, room=64, shared=8)
    d = t.spread("documents", "doc_id", "text").select("doc_id", encode("text").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return d.select("doc_id", F.round(F.array_max("v").cast("double"), 4).alias("largest"), F.round(total, 4).alias("total"))


@query("verification_modes", """
WITH f AS (SELECT o_orderkey, 'order ' || o_orderpriority || ' is ' || o_orderstatus || '.' AS one, 'order ' || o_orderpriority || ' is fine.' AS fine, o_custkey % 3 = 0 AND o_custkey % 2 = 0 AS failing FROM orders)
SELECT 'OFF' AS mode, o_orderkey, one || ' ' || one || ' Rest.' AS text, 0 AS findings, 0 AS failing, false AS patched FROM f
UNION ALL SELECT 'SHADOW', o_orderkey, one || ' ' || one || ' Rest.', 3, CAST(failing AS INTEGER), false FROM f
UNION ALL SELECT 'ENFORCE', o_orderkey, one || ' ' || CASE WHEN failing THEN fine ELSE one END || ' Rest.', 3, CAST(failing AS INTEGER), failing FROM f""")
def verification_modes(t: Tables):
    """Every order says a sentence twice; the judge fails the second one, of a third of them, half of the time with a span that is there."""
    claim = F.concat(F.lit("order "), "o_orderpriority", F.lit(" is "), "o_orderstatus", F.lit("."))
    sections = t.orders.select(F.col("o_orderkey").alias("section"), F.lit("A").alias("item"), F.concat(claim, F.lit(" "), claim, F.lit(" Rest.")).alias("text"))
    evidence = t.orders.select(F.col("o_orderkey").alias("section"), F.col("o_custkey").cast("string").alias("evidence_id"))
    replies = t.orders.select(
        F.col("o_orderkey").alias("section"), F.lit("A-002").alias("claim_id"), F.array(F.col("o_custkey").cast("string")).alias("said_ids"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("is "), "o_orderstatus")).otherwise("absent").alias("span"), F.lit("is fine").alias("replacement"),
        F.when(F.col("o_custkey") % 3 == 0, "FAIL").otherwise("PASS").alias("status"), F.lit("MINOR").alias("severity"), F.lit("UNIT_MISMATCH").alias("reason_code"))

    def judge(claims_: DataFrame) -> DataFrame:
        held = claims_.join(replies, ["section", "claim_id"], "left")
        return held.withColumns({"status": F.coalesce("status", F.lit("PASS")), "severity": F.coalesce("severity", F.lit("MINOR")), "reason_code": F.coalesce("reason_code", F.lit("SUPPORTED"))})

    found = [claims.verified(sections, evidence, judge, mode).withColumn("mode", F.lit(mode)) for mode in claims.MODES]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("mode", F.col("section").alias("o_orderkey"), "text", "findings", "failing", "patched")


@query("opinion_context", """
WITH b AS (SELECT source, doc_id, '자료: ' || source || ' / 위치: ' || doc_id || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS block FROM documents WHERE trim(text) <> ''),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM b),
k AS (SELECT source, string_agg(block, chr(10) || chr(10) ORDER BY doc_id) AS l FROM u WHERE used <= 12000 GROUP BY source)
SELECT source, sha256('[완료된 심사의견]' || chr(10) || 'A. first' || chr(10) || 'view of ' || source || chr(10) || chr(10) || 'B. second' || chr(10) || 'more on ' || source || '.'
  || chr(10) || chr(10) || '[관련 근거]' || chr(10) || coalesce(l, '별도 근거자료 없음')) AS context_sha FROM (SELECT DISTINCT source FROM documents) LEFT JOIN k USING (source)""")
def opinion_context(t: Tables):
    cases = t.documents.select("source").distinct()
    cite = " [CR_" + "a" * 20 + "]"
    sections = cases.select("source", F.lit("A").alias("review_item"), F.lit("first").alias("title"), F.concat(F.lit("view of "), "source").alias("text")).unionByName(
        cases.select("source", F.lit("B").alias("review_item"), F.lit("second").alias("title"), F.concat(F.lit("more on "), "source", F.lit(cite + ".")).alias("text")))
    rows = t.documents.select("source", F.col("doc_id").alias("position"), F.col("source").alias("source_filename"), F.col("doc_id").cast("string").alias("location"), F.col("text").alias("content"))
    return prompts.opinion_context(sections, rows, ["source"]).select("source", F.sha2("context", 256).alias("context_sha"))


@query("evidence_trace", """
WITH f AS (SELECT 'A' AS item, 'CR_' || substr(sha256('A' || chr(31) || p_partkey), 1, 20) AS id, 'credit_report' AS class, 'c' || (p_size - 1) // 12 AS view, 's · B' || p_size AS place, 'B' || p_size AS cell, NULL AS box FROM part
 UNION ALL SELECT 'A', 'ATT_' || substr(sha256('A' || chr(31) || 'G' || doc_id), 1, 20), 'attachment', source || '/' || doc_id % 3, '1페이지 · T' || doc_id % 3, NULL, doc_id % 4 FROM documents),
v AS (SELECT item, view, min(id) AS first, count(DISTINCT id) AS members, arg_min(class, id) AS source_class, arg_min(place, id) AS location, count(DISTINCT cell) AS cells, count(DISTINCT box) AS boxes FROM f GROUP BY ALL)
SELECT item AS review_item, row_number() OVER (PARTITION BY item ORDER BY first) AS ref_no, first AS representative_id, members, source_class, location, cells, boxes FROM v""")
def evidence_trace(t: Tables):
    facts = t.part.select(
        F.col("p_partkey").cast("string").alias("fact_id"), F.col("p_brand").alias("field_name"), F.col("p_size").cast("string").alias("value"), F.lit("억원").alias("unit"), F.lit("2024").alias("period"),
        F.array(F.lit("A")).alias("review_items"), F.lit(False).alias("common"), F.lit("d").alias("document_id"), F.lit("f").alias("source_filename"), F.lit("s").alias("sheet_name"),
        F.concat(F.lit("B"), F.col("p_size").cast("string")).alias("cell_range"))
    box = F.array(F.lit(0.0), (F.col("doc_id") % 4).cast("double"), F.lit(10.0), (F.col("doc_id") % 4 + 5).cast("double"))
    hits = t.documents.select(
        F.lit("A").alias("review_item"), F.concat(F.lit("G"), F.col("doc_id").cast("string")).alias("global_chunk_id"), F.col("text").alias("document"), F.col("source").alias("document_id"),
        F.col("source").alias("source_filename"), F.array(F.lit(1)).alias("pages"), F.lit(0.5).alias("score"), box.alias("bbox"),
        F.concat(F.lit("T"), (F.col("doc_id") % 3).cast("string")).alias("logical_table_id"))
    cited = evidence.assemble(facts, hits).withColumn("position", F.col("evidence_id"))
    found = grouping.trace_references(cited, "review_item")
    return found.select("review_item", "ref_no", "representative_id", "members", "source_class", "location",
                        F.size("highlight_cell_ranges").alias("cells"), F.size("highlight_bboxes").alias("boxes"))


@query("map_merge", """
SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority || '/' || CASE WHEN o_custkey % 2 = 0 THEN 'right' ELSE 'left' END AS merged FROM orders""")
def map_merge(t: Tables):
    right = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("c"), F.lit("right"), F.lit("b"), F.col("o_orderpriority"))).otherwise(
        F.create_map(F.lit("b"), F.col("o_orderpriority")))
    m = fields.merge_maps(F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.lit("old"), F.lit("c"), F.lit("left")), right)
    return t.orders.select("o_orderkey", m.alias("m")).select("o_orderkey", F.concat_ws("/", F.col("m")["a"], F.col("m")["b"], F.col("m")["c"]).alias("merged"))


@query("strict_zip", """
SELECT vec_id, unnest(range(0, len(embedding))) AS dim, round(unnest(embedding), 6) AS x FROM embeddings""")
def strict_zip(t: Tables):
    dims = F.sequence(F.lit(0), F.size("embedding") - 1)
    pairs = t.embeddings.select("vec_id", F.explode(fields.strict_zip(dims, F.col("embedding"), ("dim", "x"))).alias("p"))
    return pairs.select("vec_id", "p.dim", F.round("p.x", 6).alias("x"))


@query("review_prompt", """
WITH e AS (SELECT source, doc_id, doc_id % 7 AS view, 'view ' || doc_id % 7 AS header, lang || text AS entry FROM documents),
f AS (SELECT *, length(entry) + 1 + CASE WHEN row_number() OVER (PARTITION BY source, view ORDER BY doc_id) = 1 THEN length(header) + 2 ELSE 0 END AS chars FROM e),
u AS (SELECT *, sum(chars) OVER (PARTITION BY source ORDER BY doc_id) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM f),
k AS (SELECT * FROM u WHERE ceil(used / 1.7) + 300 <= 2100 OR n = 1),
v AS (SELECT source, view, min(doc_id) AS first, count(*) AS rows, min(header) || chr(10) || string_agg(entry, chr(10) ORDER BY doc_id) AS block FROM k GROUP BY ALL)
SELECT source, 2 AS style_rows, CAST(sum(rows) AS BIGINT) AS evidence_rows,
  sha256('[style]' || chr(10) || repeat('a', 1000) || chr(10) || source || repeat('c', 90) || chr(10) || chr(10) || '[evidence]' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY first)) AS prompt_sha
FROM v GROUP BY source""")
def review_prompt(t: Tables):
    cases = t.documents.select("source").distinct()
    styles = cases.select("source", F.posexplode(F.array(F.lit("a" * 1000), F.lit("b" * 1000), F.concat("source", F.lit("c" * 90)))).alias("rank", "text"))
    view = (F.col("doc_id") % 7).cast("string")
    rows = t.documents.select("source", F.col("doc_id").alias("position"), view.alias("view"), F.concat(F.lit("view "), view).alias("header"),
                              F.concat("lang", "text").alias("entry"))
    budget = prompts.TokenBudget(model=6000, generation=2000, completion=700, margin=1200)
    found = prompts.assemble_prompt(styles, rows, ["source"], budget, fixed_tokens=300)
    return found.select("source", "style_rows", "evidence_rows", F.sha2("prompt", 256).alias("prompt_sha"))
