"""The ordered queries again with other numbers of segments, so that groups are cut elsewhere."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = ["event_sequence", "replay_after", "illegal_transitions", "progress_violations", "idle_sessions", "islands", "fair_share",
         "ffill_section", "evidence_rank", "novelty_order", "visual_groups", "chat_history", "budget_prefix"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("segments", ["3", "29"])
@pytest.mark.parametrize("name", NAMES)
def test_hot(spark, con, name, segments):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", segments)
    try:
        ok, text = compare(spark, con, entry.queries(), entry.oracle_sql(), name, FOLDER)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ok, text
