import json

from tracewell.__main__ import main
from test_master import DOC
from test_sources import workbook


def out(path):
    return [json.loads(line) for f in sorted(path.glob("part-*")) for line in f.read_text(encoding="utf-8").splitlines()]


def test_index_retrieve_prompt_delete(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(DOC, ensure_ascii=False), encoding="utf-8")
    index = ["--index", str(tmp_path / "ix"), "--tenant-id", "t", "--case-id", "c"]
    main(["index", "--master", str(tmp_path / "m.json"), *index, "--document-id", "d", "--output", str(tmp_path / "a")])
    assert out(tmp_path / "a") == [{"tenant_id": "t", "case_id": "c", "document_id": "d", "records": 5}]
    main(["retrieve", *index, "--query", "현금 당기 금액", "--output", str(tmp_path / "b")])
    hits = sorted(out(tmp_path / "b"), key=lambda r: r["rank"])
    assert len(hits) == 5 and hits[0]["content" if "content" in hits[0] else "embedding_text"]
    main(["prompt", *index, "--query", "현금", "--top-k", "2", "--output", str(tmp_path / "p")])
    assert len(out(tmp_path / "p")) == 2 and all(r["block"].startswith("[근거 ") for r in out(tmp_path / "p"))
    main(["delete", *index, "--document-id", "d", "--output", str(tmp_path / "e")])
    assert out(tmp_path / "e") == [{"document_id": "d", "removed": 5}]


def test_parse_and_select(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook({"S": {"A1": 5}}))
    (tmp_path / "t.json").write_text('{"template_id": "t", "version": "1", "mappings": [{"field_id": "f", "sheet_name": "S", "cell": "A1", "review_items": ["A"]}]}')
    scope = ["--tenant-id", "t", "--case-id", "c", "--document-id", "d"]
    main(["credit-report-parse", "--workbook", str(tmp_path / "w.xlsx"), "--template", str(tmp_path / "t.json"), *scope, "--output", str(tmp_path / "f")])
    assert [r["value"] for r in out(tmp_path / "f")] == ["5"]
    (tmp_path / "r.json").write_text('[{"example_id": "x", "review_item_code": "B", "approval_status": "APPROVED", "loan_types": ["*"]}]')
    main(["fewshot-select", "--registry", str(tmp_path / "r.json"), "--review-item", "B", "--loan-type", "l", "--industry-code", "C", "--output", str(tmp_path / "s")])
    assert out(tmp_path / "s")[0]["example_id"] == "x"
