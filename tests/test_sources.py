import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell.functions.vectors import hash_counts
from tracewell.operators.layout import coalesce_blocks, parent_paths
from tracewell.operators.retrieval import overlap_filter
from tracewell.sources import documents, files, workbooks
from tracewell.sources.index import ChunkIndex

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets):
    """Minimal workbook: {name: {cell: value or (value, formula)}}."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        for i, cells in enumerate(sheets.values(), 1):
            body = ""
            for ref, value in cells.items():
                value, formula = value if isinstance(value, tuple) else (value, None)
                if isinstance(value, str):
                    body += f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
                else:
                    body += f'<c r="{ref}">' + (f"<f>{formula}</f>" if formula else "") + f"<v>{value}</v></c>"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData><row>{body}</row></sheetData></worksheet>")
    return out.getvalue()


def test_blocks_by_suffix(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t> 본문 </w:t></w:r></w:p><w:p/>'
                   "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b  c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "b.xlsx").write_bytes(workbook({"S": {"A1": "매출", "B1": 1250, "A2": (3, "B1+1")}}))
    (tmp_path / "c.txt").write_bytes("한글 문서".encode("cp949"))
    (tmp_path / "d.md").write_bytes("﻿# 제목\n".encode())
    (tmp_path / "e.exe").write_bytes(b"x")
    (tmp_path / "f.xlsx").write_bytes(b"broken")
    rows = files.extract_blocks(files.read_files(spark, str(tmp_path))).orderBy("path", "block_no").collect()
    got = {(r["path"][-5:], r["text"], r["location"]) for r in rows if r["error"] is None}
    assert got == {("/a.docx"[-5:], "본문", "paragraph:1"), (".docx", "a | b c", "table:1:row:1"), (".xlsx", "시트=S; A1=매출; B1=1250", "sheet:S:row:1"),
                   (".xlsx", "시트=S; A2==B1+1", "sheet:S:row:2"), ("c.txt", "한글 문서", "text"), ("/d.md", "# 제목", "text")}
    assert sorted(r["path"][-6:] for r in rows if r["error"]) == ["/e.exe", "f.xlsx"]


def test_mapped_facts(spark, tmp_path):
    (tmp_path / "credit.xlsx").write_bytes(workbook({"재무": {"B2": (1250, "C9*2"), "C2": "2025", "D2": "천원", "B3": "제조업체", "B4": " ", "AB7": 9.5}}))
    cells = files.read_cells(files.read_files(spark, str(tmp_path), "*.xlsx"))
    mapping = spark.createDataFrame([
        ("sales", "매출액", "재무", "B2", ["B"], False, None, "D2", None, "C2"), ("kind", "업종", "재무", "B3:B4", [], True, None, None, None, None),
        ("far", "먼칸", "재무", "AA5:AC9", ["A"], False, "배", None, None, None)], workbooks.MAPPING)
    facts = workbooks.mapped_facts(cells, mapping, (F.lit("t"), F.lit("c"), F.lit("d")), F.lit("credit.xlsx")).orderBy("field_id").collect()
    assert [(r["field_id"], r["value"], r["unit"], r["period"], r["formula"]) for r in facts] == [
        ("far:AB7", "9.5", "배", None, None), ("kind:B3", "제조업체", None, None, None), ("sales", "1250", "천원", "2025", "=C9*2")]
    assert all(len(r["fact_id"]) == 25 and len(r["source_hash"]) == 64 for r in facts)
    assert workbooks.missing_sheets(cells).first()["missing"] == list(workbooks.SHEET_ITEMS)


def test_parts_of_one_layout_are_parsed_once(monkeypatch):
    parsed = []
    real = files.ElementTree.fromstring
    monkeypatch.setattr(files.ElementTree, "fromstring", lambda data: parsed.append(1) or real(data))
    books = [workbook({"S1": {"A1": n}, "S2": {"AB12": (n, "A1")}}) for n in range(10)]
    found = [list(files.workbook_cells(book)) for book in books]
    assert found[3] == [("S1", 1, 1, 1, "A1", "3", None), ("S2", 2, 12, 28, "AB12", "3", "=A1")]
    assert len(parsed) == 2 * len(books) + 2  # it was four for each


def test_unit_cells_of_many_files(spark):
    """Every file takes the unit of its own cell; an empty unit cell gives none."""
    rows = spark.createDataFrame([(f"{n}.xlsx", bytearray(workbook({"S": {"A1": n, "A2": n + 1, "B1": unit}}))) for n, unit in ((10, "천원"), (20, " "), (30, "억원"))], "path string, content binary")
    mapping = spark.createDataFrame([("size", "크기", "S", "A1:A2", ["A"], False, None, "B1", None, "Z9"), ("own", "단위", "S", "B1", ["A"], False, None, "B1", None, None)], workbooks.MAPPING)
    facts = workbooks.mapped_facts(files.read_cells(rows), mapping, (F.lit("t"), F.lit("c"), F.col("path")), F.col("path")).collect()
    assert sorted((r["source_filename"], r["field_id"], r["value"], r["unit"], r["period"]) for r in facts) == [
        ("10.xlsx", "own", "천원", "천원", None), ("10.xlsx", "size:A1", "10", "천원", None), ("10.xlsx", "size:A2", "11", "천원", None),
        ("20.xlsx", "size:A1", "20", " ", None), ("20.xlsx", "size:A2", "21", " ", None),
        ("30.xlsx", "own", "억원", "억원", None), ("30.xlsx", "size:A1", "30", "억원", None), ("30.xlsx", "size:A2", "31", "억원", None)]


def test_semantic_workbook(spark, tmp_path):
    sheets = {name: {} for name in workbooks.SHEET_ITEMS}
    sheets["3. 재무현황"] = {"A1": "총괄", "A2": "현금흐름표", "A3": "영업", "B3": 5}
    sheets["2. 영업현황"] = {"A4": "매출"}
    (tmp_path / "r.xlsx").write_bytes(workbook(sheets))
    cells = files.read_cells(files.read_files(spark, str(tmp_path)))
    facts = workbooks.semantic_facts(cells, (F.lit("t"), F.lit("c"), F.lit("d")), F.lit("r.xlsx")).orderBy("sheet_order", "row").collect()
    assert [(r["field_name"], r["value"], r["review_items"]) for r in facts] == [
        ("3. 재무현황 1행", "A1=총괄", ["A", "B", "C", "D"]), ("3. 재무현황 2행", "A2=현금흐름표", ["D"]),
        ("3. 재무현황 3행", "A3=영업 | B3=5", ["D"]), ("2. 영업현황 4행", "A4=매출", ["B", "E"])]
    assert facts[2]["cell_range"] == "A3:B3"


def test_examples_and_templates(spark, tmp_path):
    (tmp_path / "wrapped.json").write_text('{"examples": [{"example_id": "x", "review_item_code": "B", "approval_status": "APPROVED", "loan_types": ["a"]}]}')
    (tmp_path / "bare.json").write_text('[{"example_id": "y", "review_item_code": "A", "approval_status": "APPROVED"}, {"example_id": "y"}]')
    assert documents.read_examples(spark, str(tmp_path / "wrapped.json")).first()["loan_types"] == ["a"]
    with pytest.raises(ValueError, match="duplicate"):
        documents.read_examples(spark, str(tmp_path / "bare.json"))
    (tmp_path / "t.json").write_text('{"template_id": "t", "version": "1", "mappings": [{"field_id": "f", "sheet_name": "S", "cell": "A1", "common": true}]}')
    row = workbooks.read_template(spark, str(tmp_path / "t.json")).first()
    assert (row["field_name"], row["cell_range"], row["common"]) == ("f", "A1", True)


def chunks(spark, data):
    df = spark.createDataFrame(data, "tenant_id string, case_id string, document_id string, chunk_id string, embedding_text string")
    return df.withColumn("vector", hash_counts("embedding_text"))


META = {"representation_level": 0, "model_id": "hash", "model_sha256": "-", "dimension": 8}


def test_index_life_cycle(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"), buckets=4)
    index.upsert(chunks(spark, [("t", "c", "doc-a", "1", "old text"), ("t", "c", "doc-b", "1", "keep this"), ("t", "c2", "doc-z", "1", "other case")]), META)
    index.upsert(chunks(spark, [("t", "c", "doc-a", "1", "new liquidity text"), ("t", "c", "doc-a", "2", "more")]), META)
    texts = {(r["document_id"], r["embedding_text"]) for r in index.read({"tenant_id": "t"}).collect()}
    assert texts == {("doc-a", "new liquidity text"), ("doc-a", "more"), ("doc-b", "keep this"), ("doc-z", "other case")}
    queries = spark.createDataFrame([("q", "new liquidity")], "query_id string, text string").withColumn("vector", hash_counts("text"))
    hits = index.search(queries, {"tenant_id": "t", "case_id": "c"}, k=2).join(index.read(), F.col("id") == F.col("chunk_no")).orderBy("rank").collect()
    assert hits[0]["embedding_text"] == "new liquidity text" and {h["case_id"] for h in hits} == {"c"}
    assert index.search(queries, {"tenant_id": "t", "case_id": "nowhere"}).count() == 0
    assert index.search(queries, {"tenant_id": "t", "case_id": ["c", "c2"]}, k=9).count() == 4
    plan = index.search(queries, {"tenant_id": "t", "case_id": "c"})._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    read = [line.split("PartitionFilters: ")[1][:200] for line in plan.splitlines() if "PartitionFilters: " in line]
    assert read and all("tenant_id" in line and "case_id" in line for line in read)
    places = index.read().select("tenant_id", "case_id", "bucket").distinct().count()
    assert len(list((tmp_path / "index" / "data").rglob("part-*.parquet"))) == places
    with pytest.raises(ValueError, match="scope"):
        index.search(queries, {"tenant_id": "t"})
    with pytest.raises(ValueError, match="compatible"):
        index.upsert(chunks(spark, [("t", "c", "d", "1", "x")]), {**META, "dimension": 384})
    with pytest.raises(ValueError, match="duplicate"):
        index.upsert(chunks(spark, [("t", "c", "d", "1", "x"), ("t", "c", "d", "1", "y")]), META)
    assert index.delete(tenant_id="t", case_id="c", document_id="doc-a") == 2
    assert index.delete(tenant_id="t", case_id="c", document_id="doc-a") == 0
    assert index.count({"tenant_id": "t", "case_id": "c"}) == 1
    assert index.delete(tenant_id="t", case_id="c") == 1 and index.count() == 1
    assert [tuple(r) for r in index.stats().collect()] == [("t", "c2", "doc-z", 1)]


def test_filters_reports_and_layout(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), (None, "y")], "k string, v string")
    cols = {"k": F.col("k")}
    count = lambda wanted: df.where(overlap_filter(cols, wanted)).count()
    assert (count({"k": ["a", None]}), count({"k": "b"}), count({"zz": None}), count({"zz": "a"})) == (2, 1, 3, 0)
    ev = spark.createDataFrame([("s", 1, "E1", "attachment", True, "충돌"), ("s", 2, "E2", "credit_report", False, " 근거  하나 "), ("u", 1, "E3", "attachment", True, "유일")],
                               "section string, rank int, evidence_id string, source_class string, in_conflict boolean, content string")
    got = {r["section"]: r["text"] for r in documents.template_sections(ev).collect()}
    assert got == {"s": "확인된 근거자료상 근거 하나 [E2]", "u": "확인된 근거자료상 유일 [E3]"}
    secs = spark.createDataFrame([("j", "B", "수익성", "좋다."), ("j", "A", "계정", "크다.")], "job_id string, review_item string, title string, text string")
    refs = spark.createDataFrame([("j", 1, "3페이지", "a.pdf")], "job_id string, ref_no int, location string, source_filename string")
    assert documents.opinion_report(secs, refs).first()["markdown"] == "# 심사의견\n\n## A. 계정\n\n크다.\n\n## B. 수익성\n\n좋다.\n\n---\n\n[1] a.pdf · 3페이지"
    blocks = spark.createDataFrame([
        ("d", 1, 1, "가", [0.0, 0.0, 50.0, 10.0], "b1"), ("d", 1, 2, "나", [5.0, 20.0, 60.0, 30.0], "b2"), ("d", 1, 3, "멀다", [0.0, 90.0, 50.0, 99.0], "b3"), ("d", 2, 4, "다음", [0.0, 0.0, 5.0, 9.0], "b4")],
        "doc string, page int, position int, text string, bbox array<double>, location string")
    rows = coalesce_blocks(blocks, "doc", max_chars=1000).orderBy("page", "position").collect()
    assert [(r["text"], r["location"], r["bbox"]) for r in rows] == [("가\n나", "b1..b2", [0, 0, 60, 30]), ("멀다", "b3", [0, 90, 50, 99]), ("다음", "b4", [0, 0, 5, 9])]
    nodes = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, ""), (4, 3, "d"), (5, 6, "x"), (6, 5, "y"), (7, 99, "z"), (8, 6, "w")], "id int, up int, t string")
    got = {r["id"]: r["path"] for r in parent_paths(nodes, "id", "up", "t").collect()}
    assert got == {1: "r", 2: "r > a", 3: "r > a", 4: "r > a > d", 5: "y > x", 6: "x > y", 7: "z", 8: "x > y > w"}
