"""Filters, score floors, first-seen deduplication and pooled vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.means import mean_vectors
from tracewell.session import cut_lineage

BROADCAST_HITS = 200_000
REQUIRED_SCOPE = ("tenant_id", "case_id")


def require_scope(filters: Mapping[str, object]) -> None:
    """Operational searches must name the tenant and the case."""
    missing = [k for k in REQUIRED_SCOPE if not filters.get(k)]
    if missing:
        raise ValueError(f"retrieval requires scope filters: {missing}")


def overlap_filter(columns: Mapping[str, Column], wanted: Mapping[str, object]) -> Column:
    """AND over keys; a key passes when its value set meets the wanted set.

    A plain value counts as a one-element set, an absent key as the set holding NULL.
    """
    out = F.lit(True)
    for key, value in wanted.items():
        options = list(value) if isinstance(value, (list, tuple, set)) else [value]
        named = [v for v in options if v is not None]
        held = columns.get(key)
        if held is None:
            out = out & F.lit(None in options)
            continue
        test = held.isin(*named) if named else F.lit(False)
        if None in options:
            test = test | held.isNull()
        out = out & F.coalesce(test, F.lit(False))
    return out


def overlap_filter_arrays(column: Column, wanted: Sequence) -> Column:
    """The same test for a list-valued key."""
    return F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def equality_filter(wanted: Mapping[str, object]) -> Column:
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.col(key).eqNullSafe(F.lit(value))
    return out


def accept_hits(hits: DataFrame, *, k: int = 8, minimum: float = 0.10, gap: float = 0.12) -> DataFrame:
    """From over-fetched hits (query_id, rank, id, score, content_hash) keep the accepted ones.

    A score must reach max(minimum, best - gap); of equal contents the first counts. The input
    holds at most 4k rows per query, so these windows are of a fixed size.
    """
    per_query = Window.partitionBy("query_id")
    floored = hits.withColumn("best_score", F.max("score").over(per_query)).withColumn(
        "score_floor", F.greatest(F.lit(minimum), F.col("best_score") - gap)).where(F.col("score") >= F.col("score_floor"))
    first = Window.partitionBy("query_id", "content_hash").orderBy("rank")
    unique = floored.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return unique.withColumn("position", F.row_number().over(per_query.orderBy("rank"))).where(F.col("position") <= k)


def with_documents(hits: DataFrame, documents: DataFrame, most: int = BROADCAST_HITS) -> DataFrame:
    """Hits with the columns of their documents (both have ``id``).

    Hits are at most k per query. Up to ``most`` of them go to the documents, which then are not
    shuffled; beyond that both sides are.
    """
    held = cut_lineage(hits)
    return documents.join(F.broadcast(held) if held.count() <= most else held, "id")


def search_quality(queries: DataFrame, hits: DataFrame, accepted: DataFrame, *, minimum: float = 0.10, gap: float = 0.12) -> DataFrame:
    """Per query: best score, floor, raw hits and the label empty / accepted / low_relevance."""
    raw = hits.groupBy("query_id").agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("raw_hit_count"))
    kept = accepted.groupBy("query_id").agg(F.count(F.lit(1)).alias("accepted_count"))
    joined = queries.join(raw, "query_id", "left").join(kept, "query_id", "left")
    return joined.select(
        "query_id", "best_score", F.greatest(F.lit(minimum), F.col("best_score") - gap).alias("score_floor"),
        F.coalesce("raw_hit_count", F.lit(0)).alias("raw_hit_count"), F.coalesce("accepted_count", F.lit(0)).alias("accepted_count"),
        F.when(F.col("raw_hit_count").isNull(), "empty").when(F.col("accepted_count") > 0, "accepted")
        .otherwise("low_relevance").alias("retrieval_quality"))


def pooled_vectors(texts: DataFrame, owner: str, text: str, encode, *, size: int = 1000, stride: int = 900) -> DataFrame:
    """One vector per owner: long texts are encoded in overlapping windows and averaged.

    ``encode`` maps a text column to a vector column.
    """
    last = F.floor((F.greatest(F.length(text) - (size - stride), F.lit(1)) - 1) / stride).cast("int")
    windows = texts.select(owner, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("_n")).select(
        owner, F.substring(F.col("_t"), F.col("_n") * stride + 1, F.lit(size)).alias("piece"))
    return mean_vectors(windows.select(owner, encode("piece").alias("vector")), owner, "vector")
