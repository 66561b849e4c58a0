"""Replace, delete, compare and count by scope."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = ("tenant_id", "case_id", "document_id")


def replace_documents(current: DataFrame, newer: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Keep documents that the new batch does not mention, then add the batch."""
    touched = newer.select(*scope).distinct()
    return current.join(touched, list(scope), "left_anti").unionByName(newer, allowMissingColumns=True)


def delete_scope(current: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.col(key).eqNullSafe(F.lit(value))
    return current.where(~out)


def index_stats(index: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Records and characters per document scope."""
    return index.groupBy(*scope).agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("embedding_text")).alias("characters"))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def require_unique(rows: DataFrame, keys: Sequence[str]) -> None:
    clash = duplicate_keys(rows, keys).limit(1).collect()
    if clash:
        raise ValueError(f"duplicate key {clash[0].asDict()}")


def missing_values(required: Sequence[str], present: Column) -> Column:
    """Required names that do not occur in an array column."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), present)


def unseen_contents(chunks: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per content that still needs a vector: distinct contents minus known ones."""
    return chunks.select(*key).distinct().join(known.select(*key).distinct(), list(key), "left_anti")
