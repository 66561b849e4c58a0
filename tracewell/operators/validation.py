"""Section checks: citations, grounding, conflicts and leakage, as one issue table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.patterns import WS
from tracewell.functions.text import anchor, citations, let, sentences_naive
from tracewell.operators.claims import _agrees, contradictions, explode_tokens
from tracewell.session import cut_lineage

ONLY_CITATIONS = rf"(?i)^(?:\[?{WS}*(?:CR|ATT)_[a-f0-9]{{20}}{WS}*\]?{WS}*)+$"


def sentences(c: Column) -> Column:
    """Naive sentences where a piece that holds only citations joins the one before it."""

    def merge(kept: Column, piece: Column) -> Column:
        joined = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1),
                          F.array(F.concat(F.try_element_at(kept, F.lit(-1)), F.lit(" "), piece)))
        return F.when((F.size(kept) > 0) & piece.rlike(ONLY_CITATIONS), joined).otherwise(F.array_append(kept, piece))

    return let(sentences_naive(c), lambda p: F.aggregate(p, F.array().cast("array<string>"), merge))


def _match(a: DataFrame, b: DataFrame, scope: list[str], how: str) -> DataFrame:
    keys = reduce(lambda x, y: x & y, (F.col(f"s.{c}") == F.col(f"k.{c}") for c in [*scope, "canonical"]))
    return a.alias("s").join(b.alias("k"), keys & _agrees("s.", "k."), how)


def validate_sections(sections: DataFrame, evidence: DataFrame, examples: DataFrame | None = None,
                      conflicts: DataFrame | None = None) -> DataFrame:
    """Issues per section (section, code, detail). The check reports, it never blocks.

    ``sections``: section, text. ``evidence``: section, evidence_id, content. ``examples``:
    section, output_example, forbidden_tokens. ``conflicts``: section, evidence_id, credit_id.
    A numeric sentence without a citation is reported once and not checked further.
    """
    # Numbers and citations are read by several checks each; scanning the texts costs most.
    known = cut_lineage(explode_tokens(evidence, "section", "evidence_id", text="content").drop("raw", "shown").distinct())
    allowed = evidence.select("section", "evidence_id").distinct()
    told = sections.select("section", F.posexplode(sentences(F.col("text"))).alias("n", "sentence"))
    cited = cut_lineage(told.select("section", "n", F.explode(citations(F.col("sentence"))).alias("evidence_id")).join(
        allowed, ["section", "evidence_id"], "left_semi"))
    numbers = cut_lineage(explode_tokens(told, "section", "n", text="sentence"))
    bound = cited.select("section", "n").distinct()

    any_cited = sections.select("section", F.explode(citations(F.col("text"))).alias("evidence_id")).join(
        allowed, ["section", "evidence_id"], "left_semi").select("section").distinct()
    missing = sections.select("section").join(allowed.select("section").distinct(), "section", "left_semi").join(
        any_cited, "section", "left_anti").select("section", F.lit("missing_evidence_citation").alias("code"), F.lit("").alias("detail"))

    uncited = numbers.join(bound, ["section", "n"], "left_anti")
    checked = numbers.join(bound, ["section", "n"], "left_semi")
    near = cited.join(known, ["section", "evidence_id"])
    unsupported = _match(checked, near, ["section", "n"], "left_anti")
    issues = [missing, _issue(uncited, "numeric_claim_without_citation"), _issue(unsupported, "unsupported_numeric_fact")]

    if conflicts is not None:
        rivals = cited.join(conflicts, ["section", "evidence_id"]).select("section", "n", "evidence_id", "credit_id").distinct()
        with_rival = near.join(rivals.select("section", "n", "evidence_id").distinct(), ["section", "n", "evidence_id"], "left_semi")
        claimed = _match(checked, with_rival, ["section", "n"], "inner").select("s.*", F.col("k.evidence_id").alias("evidence_id"))
        preferred = rivals.join(known.withColumnRenamed("evidence_id", "credit_id"), ["section", "credit_id"])
        issues.append(_issue(_match(claimed, preferred, ["section", "n", "evidence_id"], "left_anti"), "credit_report_direct_conflict"))

    if examples is not None:
        whole = explode_tokens(sections, "section")
        style = explode_tokens(examples, "section", text="output_example").drop("raw", "shown").distinct()
        foreign = _match(whole, known, ["section"], "left_anti")
        issues.append(_issue(_match(foreign, style, ["section"], "left_semi"), "few_shot_numeric_leakage"))
        tokens = examples.select("section", F.explode("forbidden_tokens").alias("shown")).where("shown <> ''").distinct()
        used = tokens.join(sections, "section").where(F.contains("text", F.col("shown"))).select("section", "shown")
        content = evidence.select(F.col("section").alias("_s"), "content")
        leaked = used.join(content, (F.col("section") == F.col("_s")) & F.contains("content", F.col("shown")), "left_anti")
        issues.append(_issue(leaked, "few_shot_token_leakage"))
    return reduce(DataFrame.unionByName, issues).withColumn("severity", F.lit("ERROR"))


def _issue(rows: DataFrame, code: str) -> DataFrame:
    """One row per section; the values all come from the one text of that section."""
    return rows.groupBy("section").agg(F.array_join(F.array_sort(F.collect_set("shown")), ", ").alias("detail")).select(
        "section", F.lit(code).alias("code"), "detail")


def cross_section_conflicts(sections: DataFrame) -> DataFrame:
    """Same anchor words, periods and unit with different values in different items.

    ``sections``: case, item, text. Only numbers with an explicit period and an anchor count.
    """
    told = sections.select("case", "item", F.explode(sentences(F.col("text"))).alias("sentence"))
    tokens = explode_tokens(told, "case", "item", "sentence", text="sentence")
    keyed = tokens.where(F.size("periods") > 0).withColumn("anchor", anchor(F.col("sentence"), F.col("raw"))).where(F.size("anchor") > 0)
    return contradictions(keyed, ["case", "anchor", "periods", "unit"], "canonical", "item")
