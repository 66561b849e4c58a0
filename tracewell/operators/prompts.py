"""Prompt blocks, token budgets and budget-limited selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import strip, token_estimate, visible_text
from tracewell.operators.ordered import ordered_columns
from tracewell.operators.topk import top_k


@dataclass(frozen=True)
class TokenBudget:
    model: int = 28672
    generation: int = 3600
    completion: int = 700
    margin: int = 1200

    def __post_init__(self) -> None:
        if self.model < 4096:
            raise ValueError("the model context is too small")
        if min(self.generation, self.completion, self.margin) < 0:
            raise ValueError("reserves cannot be negative")
        if self.input < 1500:
            raise ValueError("the reserves leave too little input")

    @property
    def input(self) -> int:
        return self.model - self.generation - self.completion - self.margin

    @property
    def style_cap(self) -> int:
        return min(4200, max(900, int(self.input * 0.22)))

    def evidence(self, fixed_tokens: int) -> int:
        return max(700, self.input - fixed_tokens)


def budget_snapshot(messages: DataFrame, keys: Sequence[str], text: Column, budget: TokenBudget,
                    count: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """Prompt tokens per key: every message costs its tokens + 8, the prompt 8 more."""
    return messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"), (F.sum(count(text) + 8) + 8).alias("prompt_tokens")
    ).withColumns({
        "input_budget_tokens": F.lit(budget.input),
        "remaining_tokens": F.greatest(F.lit(0), F.lit(budget.input) - F.col("prompt_tokens")),
        "fits": F.col("prompt_tokens") <= budget.input,
    })


def evidence_block(*, query_id: Column, level: Column, rank: Column, global_id: Column, local_id: Column,
                   document_id: Column, filename: Column, pages: Column, content: Column) -> Column:
    # Fixed text format of one block.
    return F.format_string(
        "[근거 %s]\nevidence_id=%s-L%s-R%s\nglobal_chunk_id=%s\nlocal_chunk_id=%s\ndocument_id=%s\n"
        "source_filename=%s\nsource_pages=%s\ncontent:\n%s\n",
        *[c.cast("string") for c in (rank, query_id, level, rank, global_id, local_id, document_id, filename, pages, content)])


def within_budget(rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], cost: str, budget: int,
                  *, keep_first: bool) -> DataFrame:
    """Rows in order until the first one that would exceed the budget.

    Costs are not negative, so "stop at the first overflow" equals "running sum <= budget".
    ``keep_first`` keeps the first row even when it alone is too large.
    """
    summed = ordered_columns(rows, keys, order, number="position", running={"used": cost})
    fits = F.col("used") <= budget
    if keep_first:
        fits = fits | (F.col("position") == 1)
    return summed.where(fits)


def fit_prefix(rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], group: str, header_chars: str,
               entry_chars: str, fixed_tokens: int, budget: TokenBudget) -> DataFrame:
    """Longest leading part of a selection whose grouped rendering fits the prompt.

    "Drop the last row until the prompt fits, keep one" equals taking the largest prefix that
    fits. Its length is a running sum: every entry, plus a header where a new view begins.
    """
    first = ordered_columns(rows, [*keys, group], order, number="_in_view")
    sized = first.withColumn("_chars", F.col(entry_chars) + 1 + F.when(F.col("_in_view") == 1, F.col(header_chars) + 2).otherwise(0))
    summed = ordered_columns(sized, keys, order, number="position", running={"_used": "_chars"})
    tokens = F.ceil(F.col("_used") / F.lit(1.7)) + fixed_tokens
    return summed.where((tokens <= budget.input) | (F.col("position") == 1)).drop("_in_view", "_chars", "_used")


def keep_styles(styles: DataFrame, keys: Sequence[str], rank: str, text: Column, budget: TokenBudget) -> DataFrame:
    """Style examples within their cap; the first is always kept.

    The examples come from a top-n selection, so a case has only a handful of them.
    """
    costed = styles.withColumn("_c", token_estimate(text) + 8)
    listed = costed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("_c").alias("c")))).alias("_l"))
    cap = budget.style_cap
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    fold = F.aggregate("_l", state, lambda s, e: F.when(
        (F.size(s["kept"]) == 0) | (s["used"] + e["c"] <= cap),
        F.struct((s["used"] + e["c"]).alias("used"), F.array_append(s["kept"], e["r"].cast("int")).alias("kept"))).otherwise(s))
    chosen = listed.select(*keys, fold["kept"].alias("_k"))
    return costed.join(chosen, list(keys)).where(F.array_contains("_k", F.col(rank).cast("int"))).drop("_c", "_k")


def case_context(facts: DataFrame, hits: DataFrame, keys: Sequence[str], *, most_facts: int = 60, most_hits: int = 12,
                 chars: int = 18000) -> DataFrame:
    """Context of a case question: first facts, then first hits, cut at ``chars``.

    ``facts``: keys, position, field_name, value, unit, period. ``hits``: keys, rank,
    source_filename, pages, document. At most 72 blocks per case reach the final join.
    """
    some = lambda c, before: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), F.col(c))).otherwise("")
    fact = F.concat(F.lit("신용조사서 | "), "field_name", F.lit("="), "value", some("unit", " "), some("period", " | 기간="))
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    hit = F.concat(F.lit("첨부자료 | "), F.coalesce("source_filename", F.lit("업로드 자료")), F.lit(" | 페이지="),
                   F.when(F.coalesce(pages, F.lit("")) == "", "-").otherwise(pages), F.lit("\n"), "document")
    left = top_k(facts, keys, [F.asc("position")], most_facts, "position", rank="_n").select(*keys, F.lit(0).alias("_k"), "_n", fact.alias("_b"))
    right = top_k(hits, keys, [F.asc("rank")], most_hits, "rank", rank="_n").select(*keys, F.lit(1).alias("_k"), "_n", hit.alias("_b"))
    joined = left.unionByName(right).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "_n", "_b"))).alias("_l"))
    return joined.select(*keys, F.substring(F.array_join("_l._b", "\n\n"), 1, chars).alias("context"))


def opinion_context(sections: DataFrame, evidence: DataFrame, keys: Sequence[str], *, chars: int = 12000) -> DataFrame:
    """Context of a question about a finished opinion: its sections, then evidence up to ``chars``.

    ``sections``: keys, review_item, title, text. ``evidence``: keys, position, source_filename,
    location, content. Evidence stops at the first block that would not fit.
    """
    told = F.concat("review_item", F.lit(". "), "title", F.lit("\n"), visible_text(F.col("text")))
    opinion = sections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("review_item", told.alias("t")))).alias("_s"))
    content = strip(F.col("content"))
    block = F.concat(F.lit("자료: "), F.coalesce("source_filename", F.lit("업로드 자료")), F.lit(" / 위치: "), F.coalesce("location", F.lit("-")), F.lit("\n"), content)
    blocks = evidence.where(content != "").withColumn("_b", block).withColumn("_c", F.length("_b"))
    kept = within_budget(blocks, keys, [("position", True)], "_c", chars, keep_first=False)
    listed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "_b"))).alias("_l"))
    shown = F.when(F.size("_l") > 0, F.array_join("_l._b", "\n\n")).otherwise("별도 근거자료 없음")
    return opinion.join(listed, list(keys), "left").select(*keys, F.concat(
        F.lit("[완료된 심사의견]\n"), F.array_join("_s.t", "\n\n"), F.lit("\n\n[관련 근거]\n"), shown).alias("context"))


def assemble_prompt(styles: DataFrame, evidence: DataFrame, keys: Sequence[str], budget: TokenBudget, *, fixed_tokens: int) -> DataFrame:
    """One prompt per case: styles within their cap, then the longest leading part of the evidence that fits.

    ``styles``: keys, rank, text. ``evidence``: keys, position, view, header, entry; a header stands
    where a new view begins. ``fixed_tokens`` is what everything else in the prompt costs. What is
    gathered per case is bounded by the budget.
    """
    kept = keep_styles(styles, keys, "rank", F.col("text"), budget)
    told = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_s"))
    sized = evidence.withColumns({"_header": F.length("header"), "_entry": F.length("entry")})
    fitting = fit_prefix(sized, keys, [("position", True)], "view", "_header", "_entry", fixed_tokens, budget)
    first = fitting.groupBy(*keys, "view").agg(F.min("position").alias("_from"), F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("_e"), F.first("header").alias("header"))
    block = F.concat("header", F.lit("\n"), F.array_join("_e.entry", "\n"))
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_from", block.alias("b")))).alias("_v"), F.sum(F.size("_e")).alias("evidence_rows"))
    return shown.join(told, list(keys), "left").select(*keys, F.coalesce(F.size("_s"), F.lit(0)).alias("style_rows"), "evidence_rows", F.concat(
        F.lit("[style]\n"), F.coalesce(F.array_join("_s.text", "\n"), F.lit("")), F.lit("\n\n[evidence]\n"), F.array_join("_v.b", "\n\n")).alias("prompt"))
