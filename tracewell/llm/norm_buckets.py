"""Exact top-k inner products with buckets of similar length (operator 11).

All rows are ordered by the length of their vectors and cut into places and, within these, buckets.
A bucket whose longest vector cannot reach a question's k-th score so far is left out, and so are all
after it. For the others that score gives a least cosine within the bucket. Where it is high, only
rows whose coordinates lie in the ranges it leaves around the question's largest coordinates are
verified; where it is low these ranges hold nearly everything and the rows long enough are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import batch_of
from tracewell.llm.int_vectors import (NONE, PLACE_ROWS, PLACE_VALUES, SLACK, Best, Ids, Table, alike, best_of, classes, column, matrix_of, met, others,
                                       packed)
from tracewell.session import cut_lineage

#: Rows of a bucket, and how far lengths in it may differ.
BUCKET = 2048
RATIO = 0.9
#: Coordinates that a question is tested by where its local threshold is high.
FOCUS = 3
#: The longest rows, by which every question gets a first threshold; they are sent to the tasks.
SEEDS = 1024
SEED_VALUES = 1 << 20


class Bucket:
    """Rows sorted by length, longest first, with sorted coordinates made when first asked for."""

    def __init__(self, matrix: np.ndarray, first: int):
        self.table, self.first = Table(matrix), first
        norms = self.table.norms
        self.unit = matrix / np.where(norms > 0, norms, 1)[:, None]
        spread = float(np.sqrt(self.unit.var(axis=0).mean())) if self.unit.size else 0.0
        #: From this cosine on, the range of a coordinate is no wider than the bucket's coordinates scatter.
        self.turn = float(np.sqrt(max(0.0, 1 - spread * spread)))
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, question: np.ndarray, norm: float, cosine: float) -> np.ndarray:
        """Rows that may reach the cosine, seen by the question's largest coordinates."""
        unit = question / norm
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle, reach = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(1.0, cosine))
        low, high = np.cos(np.minimum(np.pi, angle + reach)) - SLACK, np.cos(np.maximum(0, angle - reach)) + SLACK
        ranges = []
        for place, f in enumerate(focus.tolist()):
            if f not in self._sorted:
                order = np.argsort(self.unit[:, f], kind="stable")
                self._sorted[f] = order, self.unit[order, f]
            ranges.append((*np.searchsorted(self._sorted[f][1], [low[place], high[place]]), f, place))
        begin, end, f, own = min(ranges, key=lambda x: x[1] - x[0])
        found = self._sorted[f][0][begin:end]
        for place, other in enumerate(focus.tolist()):
            if place != own:
                values = self.unit[found, other]
                found = found[(values >= low[place]) & (values <= high[place])]
        return found


def buckets_of(matrix: np.ndarray, norms: np.ndarray) -> list[Bucket]:
    """``norms`` never grow; a bucket ends after ``BUCKET`` rows or where they fall below ``RATIO`` of its first."""
    found, at = [], 0
    while at < len(norms):
        end = min(len(norms), at + BUCKET, max(at + 1, int(np.searchsorted(-norms, -RATIO * norms[at], "right"))))
        found.append(Bucket(matrix[at:end], at))
        at = end
    return found


def best_in(buckets: list[Bucket], ids: Ids, questions: np.ndarray, best: Best, counts: dict[str, int] | None = None) -> None:
    """Offer to ``best`` what the buckets hold for the questions; ``counts`` sums up what was looked at."""
    norms = Table(questions).norms
    seen = counts if counts is not None else {}
    for bucket in buckets:
        need = best.floor.astype(np.float64)
        reach = norms * bucket.table.longest * (1 + SLACK)
        live = reach >= need
        if not live.any():
            break
        cosine = np.where(reach > 0, need / np.where(reach > 0, reach, 1), 0.0)
        fine = live & (cosine >= bucket.turn) & (cosine > 0)
        for k in np.flatnonzero(fine).tolist():
            rows = bucket.by_coordinate(questions[k], norms[k], cosine[k])
            seen["coordinate"] = seen.get("coordinate", 0) + len(rows)
            if len(rows):
                scores = bucket.table.products(rows, questions[k:k + 1], norms[k])[0]
                good = scores >= best.floor[k]
                best.offer(*ids.spread(np.full(good.sum(), k), rows[good] + bucket.first, scores[good]))
        asked = np.flatnonzero(live & ~fine)
        if len(asked):
            least = need[asked] / np.where(norms[asked] > 0, norms[asked], 1) * (1 - SLACK)
            most = int(np.searchsorted(-bucket.table.norms, -least.min(), "right"))
            scores = bucket.table.products(slice(0, most), questions[asked], float(norms[asked].max()))
            seen["length"] = seen.get("length", 0) + scores.size
            best.raise_to(asked, scores)
            own, rows = np.nonzero(scores >= best.floor[asked].astype(scores.dtype)[:, None])
            best.offer(*ids.spread(asked[own], rows + bucket.first, scores[own, rows]))


def _answerer(k: int):
    def build(rows: pa.Table):
        matrix = matrix_of(column(rows, "vec"))
        ids = Ids(column(rows, "ids"))
        buckets = buckets_of(matrix, -column(rows, "sorter").to_numpy())

        def answer(asked: pa.RecordBatch) -> pa.RecordBatch:
            questions = alike(matrix_of(asked.column("vec")), matrix)[0]
            best = Best(k, asked.column("low").to_numpy())
            best_in(buckets, ids, questions, best)
            return best.answer(asked.column("ref").to_numpy())

        return answer

    return build


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by length get the numbers of places of bounded size."""
    task = TaskContext.get().partitionId() << 32
    number = rows = values = 0
    for batch in batches:
        places = []
        for size in (len(x) for x in batch.column("vec").to_pylist()):
            if rows and (rows >= PLACE_ROWS or values + size > PLACE_VALUES):
                number, rows, values = number + 1, 0, 0
            rows, values = rows + 1, values + size // 2 + 1
            places.append(task | number)
        yield batch_of({"place": (pa.int64(), places)} | {n: (batch.schema.field(n).type, batch.column(n)) for n in batch.schema.names})


def _sent(places: np.ndarray, longest: np.ndarray, seeds: list[bytes], k: int):
    """Each question, with its threshold among the longest rows, to every place that can reach that."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Table(matrix_of(seeds))
        for batch in batches:
            questions = matrix_of(batch.column("vec"))
            norms = batch.column("norm").to_numpy()
            best = Best(k, np.full(len(norms), NONE))
            if seeds and len(norms):
                best.raise_to(np.arange(len(norms)), known.products(slice(None), questions, float(norms.max())))
            for place, most in zip(places.tolist(), longest.tolist()):
                taken = np.flatnonzero(norms * most * (1 + SLACK) >= best.floor)
                if len(taken):
                    chosen, n = batch.take(pa.array(taken)), len(taken)
                    yield batch_of({"place": (pa.int64(), np.full(n, place)), "kind": (pa.int32(), np.ones(n, np.int32)), "sorter": (pa.float64(), np.zeros(n)),
                                    "ref": (pa.int64(), chosen.column("ref")), "label": (pa.int64(), pa.nulls(n, pa.int64())),
                                    "vec": (pa.binary(), chosen.column("vec")), "ids": (pa.list_(pa.int64()), pa.nulls(n, pa.list_(pa.int64()))),
                                    "low": (pa.int64(), best.floor[taken]), "high": (pa.int64(), pa.nulls(n, pa.int64()))})

    return send


def nearest(rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Rows (ref, id, score): the ``k`` best of ``rows`` (as ``packed``) for each question (ref, vec, norm)."""
    spark = rows.sparkSession
    own = classes(rows, k)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = own.withColumn("sorter", -F.col("norm")).repartitionByRange(parts, "sorter", "vec").sortWithinPartitions("sorter", "vec")
    held = cut_lineage(ordered.mapInArrow(_placed, "place long, vec binary, label long, norm double, ids array<long>, sorter double"))
    # Two numbers for each place of some 65,536 rows, and the bounded seeds.
    places = held.groupBy("place").agg(F.max("norm").alias("longest")).toArrow()
    seeds, values = [], 0
    for row in held.orderBy("sorter", "vec").select("vec").limit(SEEDS).toLocalIterator():
        values += len(row.vec) // 2 + 1
        if seeds and values > SEED_VALUES:
            break
        seeds.append(bytes(row.vec))
    order = np.argsort(-places.column("longest").to_numpy(), kind="stable")
    send = _sent(places.column("place").to_numpy()[order], places.column("longest").to_numpy()[order], seeds, k)
    schema = "place long, kind int, sorter double, ref long, label long, vec binary, ids array<long>, low long, high long"
    kept = held.select("place", F.lit(0).alias("kind"), "sorter", F.lit(None).cast("long").alias("ref"), "label", "vec", "ids",
                       F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    asked = questions.select("ref", "vec", "norm").mapInArrow(send, schema)
    return best_of(met(kept.unionByName(asked), _answerer(k)), k)


def top_products(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every row with ``is_query`` the ``k`` others of highest score.

    Components are floor(256 * x), the score is their inner product, ties go to the smaller id. No part
    take rows with a NULL id, a NULL vector, a NULL or non-finite component, or a squared length of 2**62
    or more. A vector of fewer components than another counts as filled up with zeros; an empty one scores
    zero. A row that repeats an id and its vector counts once; different vectors under one id are rows of
    their own, also for each other. An empty table gives no rows; other columns are ignored.
    """
    asked = cut_lineage(packed(rows.where(is_query), id_col, vector_col).select("id", "vec", "norm", "square").distinct())
    # One search for all queries that share a vector, for one row more than asked: one may be the query's own.
    questions = cut_lineage(asked.groupBy("vec").agg(F.first("norm").alias("norm")).withColumn("ref", F.monotonically_increasing_id()))
    found = nearest(packed(rows, id_col, vector_col), questions, k + 1).groupBy("ref").agg(F.collect_list(F.struct("rank", "id", "score")).alias("found"))
    named = asked.join(questions.select("vec", "ref"), "vec").join(found, "ref")
    return named.select(F.col("id").alias("query_id"), F.posexplode(others("found", "id", "square", k)).alias("at", "row")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias("vec_id"), F.col("row.score").alias("score"))
