"""Query sets larger than one block take several passes with the same result."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from tracewell.operators import scoring

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["hybrid_rrf", "bm25", "set_similarity"])
def test_several_passes(spark, con, monkeypatch, name):
    monkeypatch.setattr(scoring, "QUERY_BLOCK", 15)
    ok, text = compare(spark, con, entry.queries(), entry.oracle_sql(), name, FOLDER)
    assert ok, text


def test_no_queries_and_wrong_dimension(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<float>")
    none = spark.createDataFrame([], "q long, v array<float>")
    assert scoring.search(corpus, none, k=3, by="dense", doc=("id", "v"), query=("q", "v")).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "q long, v array<float>")
    with pytest.raises(Exception, match="dimension"):
        scoring.search(corpus, odd, k=3, by="dense", doc=("id", "v"), query=("q", "v")).collect()
