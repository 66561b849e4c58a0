"""Order-dependent columns that stay distributed when one group is huge.

A plain window puts a whole group into one task. ``ordered_columns`` range-partitions the rows by
(keys, order), so that a large group spreads over many tasks; every task works on its own segment
and the segment totals (at most one row per key and task) carry the state from one segment to the
next. The plan is the same for all sizes. A caller that knows its groups to be of a fixed size
says ``bounded`` and gets the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

Order = Sequence[tuple[str, bool]]  # (column, ascending); together unique within a group


def _sort(order: Order) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right["_k_" + k]) for k in keys))


def _windowed(df: DataFrame, keys: Sequence[str], order: Order, number, lag, running, carry) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*_sort(order))
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added: dict[str, Column] = {}
    if number:
        added[number] = F.row_number().over(window).cast("long")
    for out, source in lag.items():
        added[out] = F.lag(source).over(window)
    for out, source in running.items():
        added[out] = F.sum(source).over(upto)
    for out, source in carry.items():
        added[out] = F.last(source, ignorenulls=True).over(upto)
    return df.withColumns(added)


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    *,
    number: str | None = None,
    lag: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    carry: Mapping[str, str] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add row number, previous value, inclusive running sum and last non-null value.

    ``lag``, ``running`` and ``carry`` map an output name to a source column. ``bounded`` states
    that no group can be large.
    """
    spec = (number, dict(lag or {}), dict(running or {}), dict(carry or {}))
    if bounded and keys:
        return _windowed(df, keys, order, *spec)
    if not keys:
        return _segmented(df.withColumn("_all", F.lit(1)), ["_all"], order, *spec).drop("_all")
    return _segmented(df, keys, order, *spec)


def _segmented(df: DataFrame, keys, order: Order, number, lag, running, carry) -> DataFrame:
    tasks = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # spark_partition_id is only stable once written, hence the checkpoint.
    spread = cut_lineage(
        df.repartitionByRange(tasks, *[F.col(k) for k in keys], *_sort(order)).withColumn(
            "_seg", F.spark_partition_id()
        )
    )
    local = _windowed(spread, [*keys, "_seg"], order, "_rn", lag, running, carry)
    totals = local.groupBy(*keys, "_seg").agg(
        F.max("_rn").alias("_n"),
        F.max_by(F.struct(F.lit(1).alias("_one"), *[F.col(c).alias("p_" + o) for o, c in lag.items()]), "_rn").alias("_last"),
        *[F.max_by(o, "_rn").alias("r_" + o) for o in running],
        *[F.max_by(o, "_rn").alias("c_" + o) for o in carry],
    )
    by_key = Window.partitionBy(*keys).orderBy("_seg")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias("_k_" + k) for k in keys],
        F.col("_seg").alias("_k__seg"),
        F.sum("_n").over(before).alias("o_n"),
        F.lag("_last").over(by_key).alias("o_last"),
        *[F.sum("r_" + o).over(before).alias("o_r_" + o) for o in running],
        *[F.last("c_" + o, ignorenulls=True).over(before).alias("o_c_" + o) for o in carry],
    )
    joined = local.join(offsets, _match(local, offsets, [*keys, "_seg"]), "left")
    final: dict[str, Column] = {}
    if number:
        final[number] = (F.col("_rn") + F.coalesce("o_n", F.lit(0))).cast("long")
    for out in lag:
        final[out] = F.when(F.col("_rn") == 1, F.col("o_last")["p_" + out]).otherwise(F.col(out))
    for out in running:
        final[out] = F.when(
            F.col(out).isNull() & F.col("o_r_" + out).isNull(), None
        ).otherwise(F.coalesce(F.col(out), F.lit(0)) + F.coalesce("o_r_" + out, F.lit(0)))
    for out in carry:
        final[out] = F.coalesce(F.col(out), F.col("o_c_" + out))
    drop = ["_rn", "_seg", "o_n", "o_last", "_k__seg", *["_k_" + k for k in keys],
            *["o_r_" + o for o in running], *["o_c_" + o for o in carry]]
    return joined.withColumns(final).drop(*drop)
