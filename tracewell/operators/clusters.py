"""Exact cosine top-k over stored clusters: whole clusters are left out by the triangle inequality.

Rows belong to the nearest of some centres, fitted on a bounded sample. Of every ring of a cluster the
least and largest angle to the centre are kept. The angle between a query and any row of a ring is at
least the distance of the query's own angle to the centre from that range. A query first visits its most
promising rings; of the others only those that may still beat its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.places import column, meet
from tracewell.operators.scoring import DIGITS
from tracewell.session import cut_lineage

#: Rows that the centres are fitted on, numbers they hold at most, rows of a cluster aimed at, and the most centres.
SAMPLE = 4096
SAMPLE_VALUES = 1 << 22
CLUSTER = 512
MOST = 1024
ROUNDS = 8
RINGS = 16
#: Rows of a place; a larger ring is dealt over several.
PLACE = 1 << 15
FIRST = 4
#: Angles from rounded products are known to this; scores are compared at nine decimals.
ANGLE_SLACK = 1e-7
SCORE_SLACK = 1e-8


def unit_rows(lists: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one size, at length one; a zero vector stays zero."""
    matrix = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return matrix / np.maximum(np.sqrt((matrix * matrix).sum(1)), 1e-12)[:, None]


def fit(sample: np.ndarray, number: int) -> np.ndarray:
    """Centres of about equal directions: far rows first, then means of the nearest."""
    far = sample @ sample[0]
    chosen = [0]
    while len(chosen) < number and far.min() < 1 - 1e-9:
        chosen.append(int(far.argmin()))
        far = np.maximum(far, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


class Clusters:
    """The clusters in a folder: rows by cluster, the rings' angles and the centres."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, rows: DataFrame, id_col: str, vector_col: str, size: int = CLUSTER) -> Clusters:
        """Write all rows with a vector; vectors must have one size. Rows of a cluster share a folder."""
        held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        number = held.count()
        drawn, values = [], 0
        for row in held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toLocalIterator():
            values += len(row.vector)
            if drawn and values > SAMPLE_VALUES:
                break
            drawn.append(row.vector)
        sample = unit_rows(pa.array(drawn, pa.list_(pa.float64()))) if drawn else np.zeros((1, 0))
        centres = fit(sample, max(1, min(MOST, len(drawn) // 4, -(-number // size))))
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cluster int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = unit_rows(batch.column(1)) @ centres.T
                cluster = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(near)), cluster], -1, 1))
                ring = np.minimum((angle * (RINGS / np.pi)).astype(np.int32), RINGS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(ring, pa.int32()), pa.array(angle), *batch.columns], names=["cluster", "ring", "angle", "id", "vector"])

        found = cut_lineage(held.mapInArrow(placed, "cluster int, ring int, angle double, id long, vector array<double>"))
        rings = found.groupBy("cluster", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
        rings = cut_lineage(rings.withColumn("parts", F.ceil(F.col("n") / PLACE).cast("int")))
        rings.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rings")
        dealt = found.join(F.broadcast(rings.select("cluster", "ring", "parts")), ["cluster", "ring"])  # at most MOST x RINGS rows
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("long")
        place = F.shiftleft((F.col("cluster") * RINGS + F.col("ring")).cast("long"), 32) + part
        dealt.withColumn("place", place).drop("parts", "angle").repartition("cluster", part).write.mode("overwrite").partitionBy("cluster").parquet(f"{self.path}/rows")
        return self

    def _rings(self, queries: DataFrame) -> DataFrame:
        """Rows (query, vector, cluster, ring, parts, n, bound): the most that a row of the ring can score, best first."""
        rings = self.spark.read.parquet(f"{self.path}/rings").toPandas()
        centres = self.spark.read.parquet(f"{self.path}/centres").orderBy("cluster").collect()
        middle = np.array([r.centre for r in centres])
        cluster, ring, low, high, parts, n = (rings[c].to_numpy() for c in ("cluster", "ring", "low", "high", "parts", "n"))

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(ring):
                    continue
                own = unit_rows(batch.column("vector"))
                if own.shape[1] != middle.shape[1]:
                    raise ValueError(f"query dimension {own.shape[1]} differs from vector dimension {middle.shape[1]}")
                angle = np.arccos(np.clip(own @ middle.T, -1, 1))[:, cluster]
                bound = np.cos(np.maximum(0, np.maximum(angle - high, low - angle) - ANGLE_SLACK))
                bound[~own.any(axis=1)] = 0.0  # a zero vector scores zero with all
                for k, query in enumerate(batch.column("query").to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ring), query)), pa.array(cluster), pa.array(ring), pa.array(parts), pa.array(n), pa.array(bound[k])],
                                                     names=["query", "cluster", "ring", "parts", "n", "bound"])

        return queries.select("query", "vector").mapInArrow(bounded, "query long, cluster int, ring int, parts int, n long, bound double")

    def _score(self, asks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k best (query, id, score) of each asked ring that reach ``least``."""
        wanted = asks.select("cluster", "ring").distinct()
        rows = self.spark.read.parquet(f"{self.path}/rows").join(wanted, ["cluster", "ring"], "left_semi").select("place", "id", "vector")
        place = F.shiftleft((F.col("cluster") * RINGS + F.col("ring")).cast("long"), 32) + F.col("part")
        spread = asks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        asked = spread.select("query", "least", place.alias("place")).join(queries.select("query", "vector"), "query")

        def build(held: pa.Table):
            ids, matrix = column(held, "id").to_numpy(), unit_rows(column(held, "vector"))

            def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
                scores = np.round(unit_rows(batch.column("vector")) @ matrix.T, DIGITS)
                out = [[], [], []]
                for own, query, least in zip(scores, batch.column("query").to_pylist(), batch.column("least").to_pylist()):
                    found = np.flatnonzero(own >= (-2.0 if least is None else least))
                    if len(found) > k:
                        cut = np.partition(own[found], len(found) - k)[len(found) - k]
                        found = found[own[found] >= cut]
                    found = found[np.lexsort((ids[found], -own[found]))[:k]]
                    for held_, value in zip(out, (np.full(len(found), query), ids[found], own[found])):
                        held_.append(value)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query", "id", "score"])

            return answer

        return meet(rows, asked, build, "query long, id long, score double")

    def plan(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rings with ``first``, hits of the first, further rings with ``least``) for queries (query, vector)."""
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "cluster", "ring")
        rings = cut_lineage(self._rings(queries).withColumn("first", F.row_number().over(order) <= FIRST))
        hits = cut_lineage(self._score(rings.where("first").withColumn("least", F.lit(None).cast("double")), queries, k))
        kth = _ranked(hits, k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
        further = rings.where("NOT first").join(kth, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SCORE_SLACK))
        return rings, hits, further

    def search(self, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
        """Rows (query_id, rank, id, score): the exact k best rows of each query by cosine at nine decimals, ties by smaller id."""
        named = self._named(queries, id_col, vector_col)
        _, hits, further = self.plan(named, k)
        best = _ranked(hits.unionByName(self._score(further, named, k)), k)
        return best.join(named.select("query", "query_id"), "query").select("query_id", "rank", "id", "score")

    def work(self, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
        """Per query the number of vectors and how many of them a search scores."""
        named = self._named(queries, id_col, vector_col)
        rings, _, further = self.plan(named, k)
        scored = rings.where("first").select("query", "n").unionByName(further.select("query", "n")).groupBy("query").agg(F.sum("n").alias("scored"))
        return rings.groupBy("query").agg(F.sum("n").alias("vectors")).join(scored, "query").join(named, "query").select("query_id", "vectors", "scored")

    def _named(self, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        own = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        return cut_lineage(own.withColumn("query", F.monotonically_increasing_id()))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
