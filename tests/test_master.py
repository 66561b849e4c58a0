import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import master
from tracewell.sources.documents import read_master


def item(text, page=1, bbox=None, source=None):
    return {"text": text, "page": page, "bbox": bbox, "source_table_id": source}


def block(i, text, y, scope="H2", page=1, x=10):
    return {"object_id": f"B{i}", "page": page, "bbox": [x, y, 100, y + 10], "text": text, "scope_heading_id": scope}


DOC = {
    "annotation": {
        "body_text": [
            block(3, "세번째", 70), block(1, " 첫   문단 ", 20), block(2, "둘째 문단", 50), block(4, "표 안", 205), block(5, "머리글", 5),
            block(6, "재무 현황", 1, scope=None), block(7, "", 90), block(8, "다른 절", 95, scope="H1"), block(9, "표 제목", 190)],
        "page_furniture": [{"page": 1, "bbox": [10, 5, 100, 15]}]},
    "semantic_elements": {
        "headings": [
            {"element_id": "H1", "text": "재무 현황", "parent_id": None, "page": 1, "bbox": [10, 1, 100, 11]},
            {"element_id": "H2", "text": "유동성", "parent_id": "H1", "page": 1, "bbox": [10, 12, 100, 16]},
            {"element_id": "H3", "text": "고리", "parent_id": "H3", "page": 1, "bbox": [0, 0, 0, 0]}],
        "tables": [
            {"table_id": "T1", "page": 1, "bbox": [10, 200, 100, 260], "matrix": [["구분", "금액", ""], ["", "당기", "전기"], ["현금", "1,000", "-"], ["차입금", "2|3", "abc"]],
             "merge_evidence": [{"row": 0, "column": 1, "row_span": 1, "col_span": 2}, {"row": 0, "column": 0, "row_span": 2, "col_span": 1}],
             "header_depth": 2, "stub_column_count": 1, "column_count": 3, "row_count": 4, "logical_table_id": "L1",
             "title": item("표 제목", bbox=[10, 190, 100, 200]), "units": [item("단위: 천원", source="T1"), item("기타", source="T9")], "notes": [item("주1"), item(" ")]},
            {"table_id": "T2", "page": 2, "bbox": [10, 20, 100, 60], "matrix": [["자본", "5", "6"]], "header_depth": 0, "stub_column_count": 1,
             "column_count": 3, "row_count": 1, "logical_table_id": "L1", "inherited_header": {"source_table_id": "T1", "source_page": 1}},
            {"table_id": "T3", "page": 2, "bbox": [10, 80, 100, 90], "matrix": [["머리", "만"]], "header_depth": 1, "stub_column_count": 1,
             "column_count": 2, "row_count": 1, "logical_table_id": "L1"},
            {"table_id": "T4", "page": 3, "bbox": [10, 10, 100, 90], "matrix": [["k", "1", "2", "3"]], "header_depth": 0, "stub_column_count": 1,
             "column_count": 4, "row_count": 1, "inherited_header": {"source_table_id": "T1"}}]},
    "raw_document": {"physical_tables": [{"page": 1, "bbox": [10, 200, 100, 260]}]},
    "table_continuity": [
        {"to": "T4", "status": "PROPOSED", "parent_child_mapping": {"successor_columns_per_parent": [9]}},
        {"to": "T4", "status": "CONFIRMED", "parent_child_mapping": {"successor_columns_per_parent": [2, 1]}}],
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("master")
    (folder / "a.json").write_text(json.dumps(DOC, ensure_ascii=False), encoding="utf-8")
    (folder / "broken.json").write_text(json.dumps({"annotation": {}, "raw_document": {}}), encoding="utf-8")
    return read_master(spark, str(folder)).cache()


def test_missing_sections_are_reported(docs):
    gaps = {r["doc_id"]: r["missing"] for r in master.missing_sections(docs).collect()}
    assert gaps == {"a.json": [], "broken.json": ["semantic_elements"]}


def test_body_blocks_and_text_windows(docs):
    rows = master.text_windows(docs.where("doc_id = 'a.json'")).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == ["CH_TEXT_00001", "CH_TEXT_00002"]
    assert rows[0]["object_ids"] == ["B1", "B2", "B3"] and rows[0]["content"] == "첫 문단\n둘째 문단\n세번째"
    assert rows[0]["section_path"] == ["재무 현황", "유동성"] and rows[0]["plain"].startswith("재무 현황\n유동성\n첫 문단")
    assert rows[1]["object_ids"] == ["B8"] and rows[1]["section_path"] == ["재무 현황"]


def test_heading_cycles_end(docs):
    heads = F.col("semantic_elements.headings")
    got = docs.where("doc_id = 'a.json'").select(master.heading_path_in(heads, F.lit("H3")).alias("p"), master.heading_path_in(heads, F.lit("nope")).alias("q")).first()
    assert got["p"] == ["고리"] and got["q"] == []


def test_headers_merges_and_inheritance(docs):
    one = docs.where("doc_id = 'a.json'")
    rows = {r["table_id"]: r for r in master.with_inherited_headers(one, master.tables_of(one)).withColumn("table_id", F.col("t.table_id")).collect()}
    assert rows["T1"]["paths"] == [["구분"], ["금액", "당기"], ["금액", "전기"]]
    assert rows["T1"]["path_ids"] == [["T1:R0:C0"], ["T1:R0:C1", "T1:R1:C1"], ["T1:R0:C1", "T1:R1:C2"]]
    assert rows["T2"]["paths"] == rows["T1"]["paths"]
    # Stub column, then the first measure twice and the second once.
    assert rows["T4"]["paths"] == [["구분"], ["금액", "당기"], ["금액", "당기"], ["금액", "전기"]]


def test_plain_and_levels(docs):
    one = docs.where("doc_id = 'a.json'")
    chunks = {r["chunk_id"]: r for r in master.check_chunk_ids(master.build_chunks(one, 0)).collect()}
    assert set(chunks) == {"CH_TEXT_00001", "CH_TEXT_00002", "CH_TABLE_T1_001", "CH_TABLE_T2_001", "CH_TABLE_T4_001"}  # T3: header only
    assert chunks["CH_TABLE_T1_001"]["embedding_text"] == (
        "표 제목\n단위: 단위: 천원\n구분=현금; 금액 > 당기=1,000; 금액 > 전기=-\n구분=차입금; 금액 > 당기=2|3; 금액 > 전기=abc\n주석: 주1")
    assert chunks["CH_TABLE_T2_001"]["pages"] == [1, 2] and chunks["CH_TABLE_T2_001"]["object_ids"] == ["T1", "T2"]
    level1 = {r["chunk_id"]: r for r in master.build_chunks(one, 1).collect()}
    payload = json.loads(level1["CH_TABLE_T1_001"]["document"])
    assert payload["elements"][0]["content"]["value"].split("\n") == [
        "| 구분 | 금액 > 당기 | 금액 > 전기 |", "| --- | ---: | ---: |", "| 현금 | 1,000 | - |", "| 차입금 | 2\\|3 | abc |"]
    assert payload["source"]["logical_table_id"] == "L1" and payload["elements"][0]["segment"]["header_depth"] == 2
    assert level1["CH_TEXT_00002"]["embedding_text"] == "문서계층: 재무 현황\n내용:\n다른 절"
    level2 = {r["chunk_id"]: r for r in master.build_chunks(one, 2).collect()}
    tree = json.loads(level2["CH_TABLE_T1_001"]["document"])["elements"][0]["hierarchy"]
    assert [c["content_type"] for c in tree["cells"]] == ["number", "missing", "text", "text"]
    assert tree["rows"][0] == {"row_id": "r2", "row_index": 2, "path": ["현금"], "source_cell_ids": ["T1:R2:C0"]}
    assert tree["spans"][0]["col_span"] == 2 and tree["columns"][1]["role"] == "measure"
    assert "셀: 행=현금; 열=금액 > 당기; 값=1,000" in level2["CH_TABLE_T1_001"]["embedding_text"]
    assert level2["CH_TEXT_00001"]["embedding_text"].startswith("계층 1: 재무 현황\n계층 2: 유동성\n본문:\n첫 문단")
    matrix = master.level_matrix(one)
    assert master.level_mismatches(matrix, 3).count() == 0


def test_row_windows_overlap(spark, docs):
    long_table = json.loads(json.dumps(DOC))
    table = long_table["semantic_elements"]["tables"][0]
    table["matrix"] = table["matrix"][:2] + [[f"r{i}", "x" * 40, "y" * 40] for i in range(10)]
    table["row_count"] = 12
    one = spark.createDataFrame([(json.dumps(long_table),)], "j string").select(F.from_json("j", master.MASTER).alias("d")).select("d.*").withColumn("doc_id", F.lit("x"))
    rows = master.table_windows(one, max_chars=256, overlap_rows=1).where("t.table_id = 'T1'").orderBy("part_index").collect()
    assert [r["row_indices"] for r in rows][:3] == [[2, 3], [3, 4], [4, 5]] and rows[0]["part_count"] == len(rows)
    with pytest.raises(ValueError):
        master.text_windows(one, max_chars=100)
