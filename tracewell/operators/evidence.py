"""Evidence rows: assembly, conflicts, ranking, novelty and budgeted selection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import patterns as P
from tracewell.functions.identity import evidence_id
from tracewell.functions.money import normalize_money, rewrite_amounts
from tracewell.functions.text import numeric_lexemes, set_cosine, terms, years
from tracewell.operators.ordered import ordered_columns
from tracewell.operators.topk import first_rows, top_k
from tracewell.session import cut_lineage


#: What an attachment carries about its place in the source.
TRACE = {"bbox": "array<double>", "page_size": "array<double>", "location": "string", "logical_table_id": "string",
         "source_spans": "array<struct<text:string,location:string,bbox:array<double>>>"}


# --- assembly -------------------------------------------------------------------------------

def assemble(facts: DataFrame, hits: DataFrame, items: Sequence[str] = P.REVIEW_ITEMS) -> DataFrame:
    """All review items at once: facts routed to their items, union of the retrieved texts.

    ``facts``: fact_id, field_name, value, unit, period, review_items, common, document_id,
    source_filename, sheet_name, cell_range. ``hits``: review_item, global_chunk_id, document,
    document_id, source_filename, pages, score, and where known bbox, page_size, location,
    logical_table_id and source_spans. A common fact without items goes everywhere. What leads back
    to the source (cell, box, place, raw value and unit) stays with every row.
    """
    everywhere = F.array(*[F.lit(i) for i in items])
    routed = F.when(F.col("common") & (F.size("review_items") == 0), everywhere).otherwise(F.col("review_items"))
    credit = facts.withColumn("review_item", F.explode(F.array_intersect(F.array_distinct(routed), everywhere))).withColumn(
        "_m", normalize_money(F.col("value"), F.col("unit")))
    unit = F.col("_m.unit")
    content = F.concat(
        F.col("field_name"), F.lit("="), F.col("_m.text"),
        F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit("; 단위="), unit)).otherwise(""),
        F.when(F.coalesce(F.col("period"), F.lit("")) != "", F.concat(F.lit("; 기간="), F.col("period"))).otherwise(""))
    left = credit.select(
        evidence_id("CR", F.col("review_item"), F.col("fact_id")).alias("evidence_id"), "review_item",
        F.when(F.col("common"), 2).otherwise(1).alias("source_tier"), F.lit("credit_report").alias("source_class"),
        content.alias("content"), "document_id", "source_filename", F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("double").alias("score"), "sheet_name", "cell_range", F.col("value").cast("string").alias("raw_value"),
        credit["unit"].cast("string").alias("raw_unit"), *[F.lit(None).cast(kind).alias(name) for name, kind in TRACE.items()])
    money = F.col("document").rlike(r"\p{Nd}\)?\s*(?:백만원|억원|만원|천원|원)")
    # Only texts with an amount go through the per-match helper.
    rewritten = hits.where(money).withColumn("content", rewrite_amounts("document")).unionByName(
        hits.where(F.coalesce(~money, F.lit(True))).withColumn("content", F.coalesce("document", F.lit(""))))
    right = rewritten.select(
        evidence_id("ATT", F.col("review_item"), F.col("global_chunk_id")).alias("evidence_id"), "review_item",
        F.lit(3).alias("source_tier"), F.lit("attachment").alias("source_class"), "content",
        F.coalesce("document_id", F.lit("unknown")).alias("document_id"), "source_filename",
        F.get("pages", 0).cast("int").alias("page"), F.col("score").cast("double").alias("score"),
        *[F.lit(None).cast("string").alias(name) for name in ("sheet_name", "cell_range", "raw_value", "raw_unit")],
        *[(F.col(name) if name in hits.columns else F.lit(None)).cast(kind).alias(name) for name, kind in TRACE.items()])
    return left.unionByName(right)


# --- direct conflicts -----------------------------------------------------------------------

def conflict_features(rows: DataFrame, scope: Sequence[str], key: str, content: str,
                      stop: Sequence[str] = P.STOP_TERMS, particles: Sequence[str] = P.PARTICLES) -> DataFrame:
    """Distinct terms, numbers and years of rows with a digit."""
    return rows.where(F.col(content).rlike(r"\p{Nd}")).select(
        *scope, F.col(key).alias("id"), terms(F.col(content), stop, particles).alias("terms"),
        F.array_sort(numeric_lexemes(F.col(content))).alias("numbers"), years(F.col(content)).alias("years"))


def _signature() -> Column:
    lists = [F.array_join(F.array_sort(c), "\x1e") for c in ("numbers", "years", "terms")]
    return F.sha2(F.concat_ws("\x1f", *lists), 256)


def _signatures(features: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per distinct feature set with its number of members.

    Copies share their features, so however many there are they take part once.
    """
    return features.withColumn("signature", _signature()).groupBy(*scope, "signature").agg(
        *[F.any_value(c).alias(c) for c in ("terms", "numbers", "years")], F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id"))


class Conflicts:
    """Direct conflicts between two sides of ``conflict_features``.

    A pair conflicts when its numbers differ, its explicit years are not disjoint, and it either
    shares at least two terms with Jaccard similarity >= ``jaccard`` or shares a year and a term.
    ``scope`` is the case and the review item: only rows that share them are compared.

    A scope with at most ``direct`` pairs of rows is decided row against row in one join. In the
    larger ones everything is decided between distinct feature sets (``groups``) that meet in an
    index; only these write their features down. ``pairs`` and ``annotate`` list the single rows.
    """

    def __init__(self, credit: DataFrame, attachment: DataFrame, scope: Sequence[str], *, jaccard: float = 0.20, direct: int = 4096):
        sides = {"credit": credit, "attachment": attachment}
        large = self._large(credit.select(*scope, F.lit(True).alias("_credit")).unionAll(
            attachment.select(*scope, F.lit(False).alias("_credit"))), scope, "_credit", direct)
        if large is None:
            self._decide(scope, jaccard, sides)
        else:
            self._decide(scope, jaccard, {k: v.join(large, [*scope], "left_anti") for k, v in sides.items()},
                         {k: v.join(large, [*scope], "left_semi") for k, v in sides.items()})

    @classmethod
    def of_rows(cls, rows: DataFrame, scope: Sequence[str], credit: str, features: Callable[[DataFrame], DataFrame], *,
                jaccard: float = 0.20, direct: int = 4096) -> Conflicts:
        """Between the rows where the column ``credit`` holds and those where it does not.

        ``features`` makes of some of the rows what ``conflict_features`` returns. Scopes are counted and
        brought together as the given columns, and those with one side are left out, before it is called:
        if it only looks texts up, neither they nor the features are shuffled.
        """
        large = cls._large(rows, scope, credit, direct)
        few = rows if large is None else rows.join(large, [*scope], "left_anti")
        place = Window.partitionBy(*scope)
        both = few.withColumns({"_any": F.max(credit).over(place), "_all": F.min(credit).over(place)}).where("_any AND NOT _all").drop("_any", "_all")

        def sides(held: DataFrame) -> dict[str, DataFrame]:
            return {"credit": features(held.where(F.col(credit))), "attachment": features(held.where(~F.col(credit)))}

        found = cls.__new__(cls)
        found._decide(scope, jaccard, sides(both), None if large is None else sides(rows.join(large, [*scope], "left_semi")))
        return found

    @staticmethod
    def _large(rows: DataFrame, scope: Sequence[str], credit: str, direct: int) -> DataFrame | None:
        """The scopes with more than ``direct`` pairs of rows, if there are any."""
        held = cut_lineage(rows.groupBy(*scope).agg(F.count_if(F.col(credit)).alias("_c"), F.count_if(~F.col(credit)).alias("_a")).where(
            F.col("_c").cast("double") * F.col("_a") > direct).select(*scope))
        return None if held.isEmpty() else held

    def _decide(self, scope: Sequence[str], jaccard: float, small: dict[str, DataFrame], large: dict[str, DataFrame] | None = None) -> None:
        both = (F.size("terms") > 0) & (F.size("numbers") > 0)
        self.scope, self.jaccard, self.groups = list(scope), jaccard, None
        if large is not None:
            # The features are read several times; they are far smaller than the texts.
            self.rows = {k: cut_lineage(v).where(both) for k, v in large.items()}
            self.sets = {k: cut_lineage(_signatures(v, self.scope)) for k, v in self.rows.items()}
            self.groups = cut_lineage(self._groups())
        self.small = {k: v.where(both) for k, v in small.items()}

    def _common(self) -> Column:
        return F.size(F.array_intersect("credit_terms", "attachment_terms"))

    def _conflict(self) -> Column:
        """The full test of a pair."""
        common = self._common()
        union = F.size("credit_terms") + F.size("attachment_terms") - common
        both_dated = (F.size("credit_years") > 0) & (F.size("attachment_years") > 0)
        same_year = F.arrays_overlap("credit_years", "attachment_years")
        return (
            (F.col("credit_numbers") != F.col("attachment_numbers")) & ~(both_dated & ~same_year)
            & (((common >= 2) & (common / union >= self.jaccard)) | (both_dated & same_year & (common >= 1))))

    def _groups(self) -> DataFrame:
        """Pairs of conflicting feature sets.

        Candidates come from equi joins within a scope: on the rare-first prefix of the term lists
        (two sets with that similarity must meet there, which leaves the most frequent terms out)
        and on (year, term), where one common term is enough. The full test runs on the candidates.
        """
        scope, jaccard = self.scope, self.jaccard
        frequency = self.sets["credit"].select(F.explode("terms").alias("term")).unionAll(
            self.sets["attachment"].select(F.explode("terms").alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

        def prefix(side: str) -> DataFrame:
            words = self.sets[side].select(*scope, "signature", F.size("terms").alias("n"), F.explode("terms").alias("term"))
            place = Window.partitionBy(*scope, "signature").orderBy("df", "term")
            ranked = words.join(frequency, "term").withColumn("at", F.row_number().over(place))
            need = F.greatest(F.ceil(F.col("n") * F.lit(jaccard) - 1e-9), F.lit(2))
            kept = ranked.where(F.col("at") <= F.col("n") - need + 1)
            return kept.select(*scope, "term", F.col("signature").alias(side), F.col("n").alias("n_" + side))

        def dated(side: str) -> DataFrame:
            held = self.sets[side].select(*scope, F.col("signature").alias(side), F.explode("years").alias("year"), "terms")
            return held.withColumn("term", F.explode("terms")).drop("terms")

        near = (F.col("n_attachment") >= F.col("n_credit") * jaccard - 1e-9) & (F.col("n_credit") >= F.col("n_attachment") * jaccard - 1e-9)
        ids = [*scope, "credit", "attachment"]
        candidates = prefix("credit").join(prefix("attachment"), [*scope, "term"]).where(near).select(*ids).unionByName(
            dated("credit").join(dated("attachment"), [*scope, "year", "term"]).select(*ids)).distinct()
        for side in ("credit", "attachment"):
            named = self.sets[side].select(*scope, F.col("signature").alias(side), *[
                F.col(c).alias(f"{side}_{c}") for c in ("terms", "numbers", "years", "members", "first_id")])
            candidates = candidates.join(named, [*scope, side])
        return candidates.where(self._conflict()).select(
            *ids, self._common().alias("common"), *[f"{s}_{c}" for s in ("credit", "attachment") for c in ("members", "first_id")])

    def _members(self, side: str) -> DataFrame:
        """(scope, row id, signature) of the rows that take part in a conflict."""
        rows = self.rows[side].select(*self.scope, F.col("id").alias(side + "_id"), _signature().alias(side))
        return rows.join(self.groups.select(*self.scope, side).distinct(), [*self.scope, side], "left_semi")

    def _direct(self) -> DataFrame:
        """Conflicting rows of the small scopes."""
        credit, attachment = [rows.select(*self.scope, *[F.col(c).alias(f"{side}_{c}") for c in ("id", "terms", "numbers", "years")])
                              for side, rows in self.small.items()]
        return credit.join(attachment, self.scope).where(self._conflict()).select(
            *self.scope, "credit_id", "attachment_id", self._common().alias("common"))

    def pairs(self) -> DataFrame:
        if self.groups is None:
            return self._direct()
        out = self.groups.select(*self.scope, "credit", "attachment", "common")
        for side in ("credit", "attachment"):
            out = out.join(self._members(side), [*self.scope, side])
        return out.select(*self.scope, "credit_id", "attachment_id", "common").unionByName(self._direct())

    def annotate(self, rows: DataFrame, key: str) -> DataFrame:
        """Sorted partner ids of every row: ``conflicts_with_credit`` and ``conflicting_attachments``.

        Partners lie in the row's own scope, a case and review item, which bounds the lists.
        """
        # Each pair once for either row, so that one grouping lists the partners of both sides.
        sides = F.array(F.struct(F.col("attachment_id").alias(key), F.col("credit_id").alias("_c"), F.lit(None).alias("_a")),
                        F.struct(F.col("credit_id").alias(key), F.lit(None).alias("_c"), F.col("attachment_id").alias("_a")))
        marks = self.pairs().select(F.inline(sides)).groupBy(key).agg(
            F.array_sort(F.collect_list("_c")).alias("conflicts_with_credit"), F.array_sort(F.collect_list("_a")).alias("conflicting_attachments"))
        return rows.join(marks, key, "left").withColumns({
            c: F.coalesce(F.col(c), F.array().cast(marks.schema[c].dataType)) for c in ("conflicts_with_credit", "conflicting_attachments")})


# --- ranking --------------------------------------------------------------------------------

def selection_score(query_terms: Column, content_terms: Column, source_class: Column, vector: Column,
                    priority: Column, supporting: Column, conflict: Column) -> Column:
    clamped = F.when(source_class == "attachment", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(vector, F.lit(0.0))))).otherwise(0.0)
    score = set_cosine(query_terms, content_terms) + F.greatest(F.lit(0.0), clamped) * 0.35
    score = score + F.when(priority, 1.5).when(supporting, 0.75).otherwise(0.0)
    return F.round(score + F.when(conflict, 0.25).otherwise(0.0), 9)


def rank_evidence(rows: DataFrame, case: str, score: str, key: str, rank: str = "rank") -> DataFrame:
    return ordered_columns(rows, [case], [(score, False), (key, True)], number=rank)


def mark_first_of_group(rows: DataFrame, case: str, group: str, score: str, key: str, flag: str = "is_first") -> DataFrame:
    """Flag the best row of every source view; found by aggregation, joined back by its own key."""
    firsts = first_rows(rows.select(case, group, (-F.col(score)).alias("_o"), key), [case, group], ["_o", key])
    return rows.join(firsts.select(case, key, F.lit(True).alias(flag)), [case, key], "left").fillna(False, [flag])


def novelty_order(rows: DataFrame, case: str, group: str, score: str, key: str) -> DataFrame:
    """New source views first (by rank), repeats of a view after them (by rank)."""
    marked = mark_first_of_group(rows, case, group, score, key)
    return ordered_columns(marked, [case], [("is_first", False), (score, False), (key, True)], number="position")


def select_within_budget(rows: DataFrame, case: str, *, group: str, score: str, key: str, cost: str, source_class: str,
                         budget: int, credit_share: float = 0.5) -> DataFrame:
    """Greedy selection per case: credit rows up to their share, then the best of the rest.

    A row that does not fit is skipped and later ones are still tried. The fold is sequential,
    so each case is first cut to the rows that could possibly be chosen. The remaining budget
    never grows: once a row of cost c is refused, every later row of cost c is refused too.
    Hence at most budget/c rows of one cost are chosen, and within equal (class, cost,
    first-of-view) they are the leading ones; twice that many leading rows cover both passes.
    What reaches the fold is therefore bounded by the budget alone, whatever the case size.
    ``cost`` must be at least 1.
    """
    # The few columns needed are scored once and written down; they are read three times.
    slim = cut_lineage(rows.select(case, group, score, key, cost, source_class))
    marked = mark_first_of_group(slim, case, group, score, key).select(
        F.col(case).alias("case"), F.col(group).alias("view"), F.col(score).alias("score"), F.col(key).alias("key"),
        F.col(cost).cast("long").alias("cost"), (F.col(source_class) == "credit_report").alias("credit"), "is_first")
    totals = marked.where("credit").groupBy("case").agg(F.sum("cost").alias("credit_total"))
    fitting = marked.where(F.col("cost") <= budget)
    strata = ["case", "credit", "cost", "is_first"]
    order = [F.desc("score"), F.asc("key")]
    quota = 2 * F.floor(F.lit(budget) / F.col("cost"))
    salted = fitting.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(256)))
    near = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*strata, "_salt").orderBy(*order))).where(F.col("_n") <= quota)
    cut = near.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_n") <= quota)
    held = cut.drop("_n", "_salt").join(totals, "case", "left").fillna(0, ["credit_total"])
    kind = {f.name: f.dataType for f in held.schema}
    schema = (T.StructType().add("case", kind["case"]).add("key", kind["key"]).add("score", "double").add("cost", "long")
              .add("credit", "boolean").add("pass", "integer"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        return _choose(frame, budget, credit_share)

    return held.groupBy("case").applyInPandas(choose, schema)


def _choose(frame: pd.DataFrame, budget: int, credit_share: float) -> pd.DataFrame:
    ranked = frame.sort_values(["score", "key"], ascending=[False, True])
    target = min(int(ranked["credit_total"].iloc[0]), int(budget * credit_share))
    used = credit_used = 0
    taken: dict = {}
    seen = set()
    credit = ranked[ranked["credit"]]
    for row in pd.concat([credit[credit["is_first"]], credit[~credit["is_first"]]]).itertuples():
        if credit_used >= target:
            break
        if used + row.cost <= budget:
            taken[row.key] = 1
            seen.add(row.view)
            used += row.cost
            credit_used += row.cost
    rest = ranked[~ranked["key"].isin(list(taken))]
    fresh = rest["is_first"] & ~rest["view"].isin(list(seen))
    for row in pd.concat([rest[fresh], rest[~fresh]]).itertuples():
        if used + row.cost <= budget:
            taken[row.key] = 2
            used += row.cost
    out = ranked[ranked["key"].isin(list(taken))]
    return out.assign(**{"pass": out["key"].map(taken).astype("int32")})[["case", "key", "score", "cost", "credit", "pass"]]


# --- materiality ----------------------------------------------------------------------------

def materiality_score(item: Column, content: Column, conflict: Column, vector: Column,
                      weights: Mapping[str, Mapping[str, float]] = P.ITEM_WEIGHTS) -> Column:
    base = F.lit(0.0)
    for name, table in weights.items():
        total = F.lit(0.0)
        for term, weight in table.items():
            total = total + F.when(content.contains(term), F.lit(weight)).otherwise(0.0)
        base = F.when(item == name, total).otherwise(base)
    count = F.size(F.regexp_extract_all(content, F.lit(P.NUMBER), F.lit(0)))
    score = base + F.least(F.lit(0.7), count * F.lit(0.08))
    score = score + F.when(F.size(years(content)) >= 2, 0.55).otherwise(0.0)
    score = score + F.when(conflict, 0.75).otherwise(0.0)
    return F.bround(score + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(vector, F.lit(0.0)))) * 0.35, 4)


def materiality(score: Column) -> Column:
    return F.when(score >= 2.4, "HIGH").when(score >= 1.25, "MEDIUM").otherwise("LOW")


def priority_issues(assessed: DataFrame, keys: Sequence[str], score: str, key: str, *, most: int = 5, fallback: int = 3) -> DataFrame:
    """Per item the material rows (at most ``most``); without any, the first ``fallback``."""
    best = top_k(assessed, keys, [F.desc(score), F.asc(key)], most, key)
    level = materiality(F.col(score))
    any_material = F.max(F.when(level != "LOW", 1).otherwise(0)).over(Window.partitionBy(*keys))
    return best.withColumn("materiality", level).withColumn("_m", any_material).where(
        ((F.col("_m") == 1) & (F.col("materiality") != "LOW")) | ((F.col("_m") == 0) & (F.col("rank") <= fallback))).drop("_m")


def cross_signals(rows: DataFrame, case: str, item: str, content: str, signals=P.CROSS_SIGNALS) -> DataFrame:
    """Signals across items. "Term occurs in the texts of an item" is a mergeable OR, so the
    texts are never concatenated."""

    def present(group: Mapping[str, Sequence[str]]) -> Column:
        hit = F.lit(False)
        for name, words in group.items():
            for word in words:
                hit = hit | ((F.col(item) == name) & F.col(content).contains(word))
        return F.bool_or(hit)

    flags = rows.groupBy(case).agg(*[
        F.when(present(left) & present(right), F.lit(name)).alias(name) for name, (left, right) in signals.items()])
    return flags.select(case, F.explode(F.array_compact(F.array(*signals))).alias("signal"))


# --- few-shot selection ---------------------------------------------------------------------

def industry_score(codes: Column, industry: Column) -> Column:
    """Best of wildcard 1, exact 12, prefix either way 4 + shorter length; NULL when none fits."""
    scored = F.transform(codes, lambda c: F.when(c == "*", 1).when(c == industry, 12).when(
        F.startswith(industry, c) | F.startswith(c, industry), 4 + F.least(F.length(c), F.length(industry))))
    return F.when(F.size(codes) == 0, F.lit(0)).otherwise(F.array_max(scored))


def select_examples(cases: DataFrame, examples: DataFrame, *, case: str, n: int = 3) -> DataFrame:
    """Best ``n`` approved examples per case and item by loan type, industry and tags.

    ``cases``: <case>, review_item, loan_type, industry_code, tags. ``examples``: example_id,
    review_item, approval_status, loan_types, industry_codes, tags. Cases with equal attributes
    are scored once; candidates come from an equi join on item and loan type. Examples that no case
    can tell apart (same item, loan types, industries and tags that occur in a case) always score
    alike, so only the first ``n`` of them enter the join, however many wildcards there are.
    """
    profile = ["review_item", "loan_type", "industry_code", "tags"]
    approved = examples.where("approval_status = 'APPROVED'").select(
        "example_id", "review_item", "loan_types", F.col("industry_codes"), F.col("tags").alias("_tags"),
        F.explode(F.when(F.size("loan_types") == 0, F.array(F.lit(""))).otherwise(F.array_distinct("loan_types"))).alias("_loan"))
    asked = cases.select(F.explode("tags").alias("_tag")).distinct()
    known = approved.select("example_id", F.explode("_tags").alias("_tag")).distinct().join(asked, "_tag", "left_semi").groupBy("example_id").agg(
        F.array_sort(F.collect_set("_tag")).alias("_tags"))
    alike = approved.drop("_tags").join(known, "example_id", "left").withColumns({
        "_tags": F.coalesce("_tags", F.array().cast("array<string>")), "loan_types": F.array_sort(F.array_distinct("loan_types")),
        "industry_codes": F.array_sort(F.array_distinct("industry_codes"))})
    approved = top_k(alike, ["review_item", "_loan", "loan_types", "industry_codes", "_tags"], [F.asc("example_id")], n, "example_id", rank="_first").drop("_first")
    distinct = cases.select(*profile).distinct().withColumn("_profile", F.to_json(F.struct(*profile)))
    wanted = distinct.withColumn("_loan", F.explode(F.array_distinct(F.array(F.col("loan_type"), F.lit("*"), F.lit("")))))
    points = F.when(F.col("_loan") == "", 0).when(F.col("_loan") == F.col("loan_type"), 10).otherwise(1)
    # An example that lists the loan type and the wildcard meets a case once, by the loan type.
    twice = (F.col("_loan") == "*") & (F.col("loan_type") != "*") & F.array_contains("loan_types", F.col("loan_type"))
    scored = wanted.join(approved, ["review_item", "_loan"]).where(~twice).withColumn(
        "_ind", industry_score(F.col("industry_codes"), F.col("industry_code"))).where(F.col("_ind").isNotNull())
    scored = scored.select("_profile", "example_id", (points + F.col("_ind") + 2 * F.size(F.array_intersect("tags", "_tags"))).alias("score"))
    ranked = top_k(scored, ["_profile"], [F.desc("score"), F.asc("example_id")], n, "example_id")
    held = cases.select(case, *profile).withColumn("_profile", F.to_json(F.struct(*profile)))
    return held.join(ranked, "_profile").select(case, "review_item", "rank", "example_id", "score")
