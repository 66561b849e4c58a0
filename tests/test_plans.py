"""What the optimizer may not copy: helpers and cleaning run once a row, not in filters and for every element."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


# Helpers in Python: blocks outside, packing and paths for texts, packing for tables; once for all levels.
@pytest.mark.parametrize("name, helpers", [("body_blocks", 1), ("render_levels", 4), ("level_matrix", 4), ("level_payload", 4)])
def test_master_queries_work_once(spark, name, helpers):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == helpers
    # A heading's path is walked in a helper, not by a fold over all headings for each window.
    assert "aggregate(coalesce(semantic_elements" not in plan


def test_workbooks_are_opened_once(spark):
    """Facts, units and periods come from one reading of the cells, and a template is not joined by shuffling every cell to its sheet."""
    plan = entry.queries()["mapped_workbooks"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("MapInPandas") == 0
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_conflicts_shuffle_keys_only(spark):
    """Rows come together by case and item before their texts are looked up; the lists of terms made of these were shuffled."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(limit)
    spark.conf.set(limit, "20000")  # parts are looked up, lines are not
    try:
        plan = entry.queries()["conflict_pairs"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, held)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    lines = plan.splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert below and not any("terms" in line or "regexp" in line for line in below)


def test_sections_are_scanned_once(spark):
    """Of the numbers only those of whole sections and of examples are found while the issues are joined; each check scanned the texts anew."""
    plan = entry.queries()["section_leaks"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_long_document(spark):
    """A document of 4000 lines takes seconds; its headings were gone through for every heading of every window."""
    from pyspark.sql import functions as F

    from tracewell.operators import master
    from tracewell.plans import master_queries

    class Tables:
        def spread(self, *names):
            lines = F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.concat(F.lit("line "), i.cast("string")))
            return spark.range(1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"),
                                         F.array_join(lines, "\n").alias("text"))

    rows = master.text_windows(master_queries._masters(Tables()), max_chars=master_queries.WIDE, overlap=0)
    last = rows.orderBy(F.desc("chunk_id")).first()
    assert rows.count() == 1000 and last["chunk_id"] == "CH_TEXT_01000" and last["object_ids"] == ["B3996", "B3997", "B3998"]
    assert last["section_path"] == ["part 999"]
