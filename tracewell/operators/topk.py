"""Top-k per group without sending a whole group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: str,
    *,
    rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """Exact top-k per group in two levels.

    Level one ranks inside (group, salt) - Spark also trims each map task to k rows before
    that shuffle - so the second level sees at most ``salts * k`` rows per group.
    ``spread`` is a column with many distinct values; ``order`` must be total.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    part = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop("_rn", "_salt")
    last = Window.partitionBy(*keys).orderBy(*order)
    return part.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group, the smallest by ``order``: a map-side combined ``min_by``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
