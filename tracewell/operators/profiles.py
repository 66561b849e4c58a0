"""Query profiles: five review items per case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import patterns as P


def query_profiles(cases: DataFrame, *, loan: Column, industry: Column, company: Column,
                   terms: Mapping[str, Sequence[str]] = P.ITEM_PROFILE_TERMS) -> DataFrame:
    """One profile text per case and review item; the five items are exploded from a literal."""
    missing = set(P.REVIEW_ITEMS) - set(terms)
    if missing:
        raise ValueError(f"query profiles missing: {sorted(missing)}")
    items = F.array(*[
        F.struct(F.lit(i).alias("item"), F.lit(P.ITEM_TITLES[i]).alias("title"), F.lit(", ".join(terms[i])).alias("terms"))
        for i in P.REVIEW_ITEMS])
    name = F.when(F.coalesce(company, F.lit("")) != "", F.concat(F.lit("대상기업 "), company))
    return cases.withColumn("_p", F.explode(items)).withColumns({
        "review_item": F.col("_p.item"),
        "profile": F.concat_ws(
            "\n", F.col("_p.title"), F.concat(F.lit("여신유형 "), loan), F.concat(F.lit("산업분류 "), industry.cast("string")),
            name, F.concat(F.lit("검색개념 "), F.col("_p.terms"))),
    }).drop("_p")
