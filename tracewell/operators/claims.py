"""Claims, citations, numeric grounding and contradictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.spans import claim_spans, exploded_numbers
from tracewell.functions.text import citations
from tracewell.operators.fields import scale_finding, splice_patch


def padded(n: Column, width: int = 3) -> Column:
    """Zero-padded number; longer numbers are not cut."""
    digits = n.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def segment_claims(sections: DataFrame, key: str, allowed: Column | None = None) -> DataFrame:
    """One row per claim of (key, item, text) with offsets and the cited ids that are allowed."""
    held = [key, "item"] + (["_allowed"] if allowed is not None else [])
    base = sections if allowed is None else sections.withColumn("_allowed", allowed)
    out = base.select(*held, F.posexplode(claim_spans("text")).alias("n", "s"))
    cited = citations(F.col("s.text"))
    if allowed is not None:
        cited = F.array_intersect(cited, F.col("_allowed"))
    return out.select(
        key, "item", F.concat(F.col("item"), F.lit("-"), padded(F.col("n") + 1)).alias("claim_id"),
        F.col("s.text").alias("claim"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"),
        cited.alias("evidence_ids"))


def explode_tokens(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, raw, canonical, kind, unit, periods, shown): one row per typed number."""
    return exploded_numbers(rows.where(F.col(text).rlike(r"\p{Nd}")), text, *keys, name="t").select(
        *keys, "t.raw", "t.canonical", "t.kind", "t.unit", "t.periods",
        F.concat(F.col("t.raw"), F.coalesce("t.unit", F.lit(""))).alias("shown"))


def _agrees(said: str, known: str) -> Column:
    """Kind equal (year and number are interchangeable), units and periods equal or missing."""
    kind_s, kind_k = F.col(said + "kind"), F.col(known + "kind")
    unit_s, unit_k = F.col(said + "unit"), F.col(known + "unit")
    period_s, period_k = F.col(said + "periods"), F.col(known + "periods")
    loose = kind_s.isin("year", "number") & kind_k.isin("year", "number")
    return (
        ((kind_s == kind_k) | loose)
        & (unit_s.isNull() | unit_k.isNull() | (unit_s == unit_k))
        & ((F.size(period_s) == 0) | (F.size(period_k) == 0) | F.arrays_overlap(period_s, period_k))
    )


def ungrounded(said: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """Stated numbers without a matching number in their scope (anti join on the value).

    The evidence side is reduced to distinct tokens first, so repeated values cannot pile up
    under one join key.
    """
    facts = known.select(*scope, "canonical", "kind", "unit", "periods").distinct()
    a, b = said.alias("s"), facts.alias("k")
    keys = [F.col(f"s.{c}") == F.col(f"k.{c}") for c in [*scope, "canonical"]]
    condition = _agrees("s.", "k.")
    for k in keys:
        condition = k & condition
    return a.join(b, condition, "left_anti")


def grounded(said: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    facts = known.select(*scope, "canonical", "kind", "unit", "periods").distinct()
    condition = _agrees("s.", "k.")
    for c in [*scope, "canonical"]:
        condition = (F.col(f"s.{c}") == F.col(f"k.{c}")) & condition
    return said.alias("s").join(facts.alias("k"), condition, "left_semi")


def contradictions(claims: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """Keys with more than one value and more than one item.

    "More than one distinct" is min <> max, which merges map-side; a distinct count would
    multiply the rows and ship every value.
    """
    return claims.groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.min(item).alias("_i0"), F.max(item).alias("_i1"),
        F.count(F.lit(1)).alias("claims"),
    ).where((F.col("low") != F.col("high")) & (F.col("_i0") != F.col("_i1"))).drop("_i0", "_i1")


def bind_evidence(claims: DataFrame, evidence: DataFrame, section: str) -> DataFrame:
    """Evidence per claim: the cited rows, or every row of the section when none is cited.

    ``evidence`` has (section, evidence_id). Result: one row per claim and bound evidence.
    """
    cited = claims.where(F.size("evidence_ids") > 0).withColumn("evidence_id", F.explode("evidence_ids"))
    direct = cited.join(evidence.select(section, "evidence_id"), [section, "evidence_id"], "left_semi")
    bound = direct.select(section, "claim_id", "evidence_id")
    uncited = claims.join(bound.select(section, "claim_id").distinct(), [section, "claim_id"], "left_anti")
    return bound.unionByName(uncited.select(section, "claim_id").join(evidence.select(section, "evidence_id"), section))


def apply_patches(text: Column, patches: Column, limit: int = 1) -> Column:
    """Replace [start, stop) ranges, last range first so that earlier offsets stay valid.

    ``patches`` is array<struct<start,stop,text>>; the first ``limit`` by start are applied.
    """
    chosen = F.reverse(F.slice(F.array_sort(patches), 1, limit))
    return F.aggregate(chosen, text, lambda t, p: F.concat(
        F.substring(t, F.lit(1), p["start"]), p["text"], F.substring(t, p["stop"] + 1, F.length(t))))


MODES = ("OFF", "SHADOW", "ENFORCE")


def bound_claims(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims of (section, item, text) with their offsets, cited ids and ``bound``, the evidence each is judged by.

    ``evidence`` has (section, evidence_id); a section's evidence is what its prompt could hold.
    """
    allowed = evidence.groupBy("section").agg(F.collect_set("evidence_id").alias("_ids"))
    known = sections.join(allowed, "section", "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<string>")))
    claims = segment_claims(known, "section", F.col("_ids"))
    bound = bind_evidence(claims, evidence, "section").groupBy("section", "claim_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("bound"))
    return claims.join(bound, ["section", "claim_id"], "left").withColumn("bound", F.coalesce("bound", F.array().cast("array<string>")))


def judged_claims(claims: DataFrame) -> DataFrame:
    """Findings of judged claims with their final ``verdict`` and ``reason`` and, if there is one, the ``repaired`` claim.

    ``claims`` are ``bound_claims`` with the reply of a judge: status, severity, reason_code, span,
    replacement and said_ids, the evidence ids that it names.
    """
    known = F.size(F.array_intersect("said_ids", "bound"))
    outcome = scale_finding(*[F.col(c) for c in ("status", "severity", "reason_code", "span", "claim")], F.size("bound"), known)
    judged = claims.withColumn("_f", outcome).withColumns({"verdict": F.col("_f.status"), "reason": F.col("_f.reason_code")}).drop("_f")
    repaired = splice_patch(F.col("claim"), F.col("span"), F.col("replacement"), F.upper("severity"))
    return judged.withColumn("repaired", F.when((F.col("verdict") == "FAIL") & (repaired != F.col("claim")), repaired))


def verified(sections: DataFrame, evidence: DataFrame, judge: Callable[[DataFrame], DataFrame], mode: str, *, most: int = 1) -> DataFrame:
    """Sections after verification: (section, text, findings, failing, patched).

    Segments the text of (section, item, text), binds evidence to each claim, asks ``judge`` (see
    ``judged_claims``) and patches. OFF asks nothing; SHADOW counts all findings and the failing ones;
    ENFORCE also puts the first ``most`` repaired claims into their own places, told by offset, so that of equal
    sentences the one that was judged is changed.
    """
    if mode not in MODES:
        raise ValueError(f"unknown verification mode {mode}")
    none = F.lit(0).cast("long")
    if mode == "OFF":
        return sections.select("section", "text", none.alias("findings"), none.alias("failing"), F.lit(False).alias("patched"))
    judged = judged_claims(judge(bound_claims(sections, evidence)))
    patch = F.when(F.col("repaired").isNotNull(), F.struct("start", "stop", F.col("repaired").alias("text")))
    marks = judged.groupBy("section").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("verdict") == "FAIL").alias("failing"), F.collect_list(patch).alias("_patches"))
    held = sections.join(marks, "section", "left")
    usable = F.coalesce(F.size("_patches") > 0, F.lit(False)) & F.lit(mode == "ENFORCE" and most > 0)
    return held.select("section", F.when(usable, apply_patches(F.col("text"), F.col("_patches"), max(1, most))).otherwise(F.col("text")).alias("text"),
                       F.coalesce("findings", none).alias("findings"), F.coalesce("failing", none).alias("failing"), usable.alias("patched"))
