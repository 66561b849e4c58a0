"""Accept what a generator proposes only where it refers to known evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.operators.fields import json_object

_ISSUE = "struct<title:string,materiality:string,direction:string,why_it_matters:string,evidence_ids:array<string>>"
_REPLY = (
    f"items map<string,struct<judgment_focus:string,priority_issues:array<{_ISSUE}>>>, "
    "cross_item_signals array<struct<type:string,result:string,why:string,evidence_ids:array<string>>>"
)


def _known(rows: DataFrame, keys: list[str], evidence: DataFrame, scope: list[str]) -> DataFrame:
    """Proposed ids that exist in their scope, in proposed order, per key."""
    ids = rows.select(*dict.fromkeys([*keys, *scope]), F.posexplode("evidence_ids").alias("_at", "evidence_id"))
    held = ids.join(evidence.select(*scope, "evidence_id").distinct(), [*scope, "evidence_id"], "left_semi")
    listed = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "evidence_id"))).alias("_l"))
    return listed.select(*keys, F.col("_l.evidence_id").alias("known_ids"))


def accept_issues(replies: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """Issues of a reply that cite known evidence and are HIGH or MEDIUM, at most ``most`` per item.

    ``replies``: case, reply (text with one JSON object somewhere). ``evidence``: case,
    review_item, evidence_id. Lists are as long as one reply made them.
    """
    parsed = replies.select("case", json_object(F.col("reply"), _REPLY).alias("r")).where("r IS NOT NULL")
    items = parsed.select("case", F.explode("r.items").alias("review_item", "i")).where(F.col("review_item").isin(*P.REVIEW_ITEMS))
    issues = items.select("case", "review_item", "i.judgment_focus", F.posexplode("i.priority_issues").alias("at", "s")).select(
        "case", "review_item", "judgment_focus", "at", "s.*").withColumn("materiality", F.upper(F.coalesce("materiality", F.lit("MEDIUM"))))
    keys = ["case", "review_item", "at"]
    good = issues.where(F.col("materiality").isin("HIGH", "MEDIUM")).join(_known(issues, keys, evidence, ["case", "review_item"]), keys)
    ordered = good.groupBy("case", "review_item").agg(F.slice(F.array_sort(F.collect_list(F.struct(
        "at", "title", "materiality", "direction", "why_it_matters", "known_ids", "judgment_focus"))), 1, most).alias("l"))
    rows = ordered.select("case", "review_item", F.posexplode("l").alias("n", "s"))
    return rows.select("case", "review_item", (F.col("n") + 1).alias("rank"), "s.title", "s.materiality", "s.direction", "s.why_it_matters",
                       F.col("s.known_ids").alias("evidence_ids"), "s.judgment_focus")


def with_fallback(accepted: DataFrame, fallback: DataFrame) -> DataFrame:
    """Deterministic issues for every (case, item) without an accepted one."""
    rest = fallback.join(accepted.select("case", "review_item").distinct(), ["case", "review_item"], "left_anti")
    return accepted.unionByName(rest, allowMissingColumns=True)


def accept_signals(replies: DataFrame, evidence: DataFrame, most: int = 6) -> DataFrame:
    """The first ``most`` cross-item signals of a reply; unknown ids are dropped from them."""
    parsed = replies.select("case", json_object(F.col("reply"), _REPLY).alias("r")).where("r IS NOT NULL")
    signals = parsed.select("case", F.posexplode(F.slice("r.cross_item_signals", 1, most)).alias("at", "s")).select("case", "at", "s.*")
    known = _known(signals, ["case", "at"], evidence, ["case"])
    out = signals.join(known, ["case", "at"], "left")
    return out.select("case", (F.col("at") + 1).alias("rank"), "type", "result", "why",
                      F.coalesce("known_ids", F.array().cast("array<string>")).alias("evidence_ids"))
