"""The queries with SQL on the second smallest tables, and the columns of all of them."""

import pytest
from compare import compare, connect

from tracewell.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4": ["doc_id", "n_pieces", "ids_sha256", "round_trip"],
    "op5": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op6": ["page_id", "url", "text", "n_chars"],
    "op7": ["doc_id", "held_out", "lang_pred", "score"],
    "op8": ["doc_id", "fingerprint", "component_id"],
    "op9": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op11": ["query_id", "rank", "vec_id", "score"],
    "op12": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13": ["word", "form", "root", "n", "n_near", "form_n"],
}


def test_each_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    folder = "/root/testdata/sf0.001"
    found = QUERIES[name](spark, folder)
    want = COLUMNS[name.split("_")[0]]
    assert found.columns[:len(want)] == want
    if want[0] not in ("doc_id", "page_id"):
        assert found.count() > 10
        return
    assert found.count() == spark.read.parquet(f"{folder}/{'pages' if want[0] == 'page_id' else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    ok, text = compare(spark, connect(folder), QUERIES, ORACLES, name, folder)
    assert ok, text


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op7_language_id"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
