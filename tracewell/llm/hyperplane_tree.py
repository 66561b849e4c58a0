"""Hard-negative mining with a multiway hyperplane tree (operator 12).

Every inner node has a few split points; a row goes to the subtree of the nearest. Each split point
keeps the least and largest distance to the rows of every sibling subtree. A question asks for scores
in a window; with the lengths of a subtree's rows that is an annulus of distances around its anchor.
A subtree is left out if, by any split point, no distance in the stored range agrees with the annulus.
Leaves are compared exactly.

The split points are fitted on a bounded sample; every row is routed to its leaf and enters the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import batch_of
from tracewell.llm.int_vectors import MET, NONE, PLACE_ROWS, PLACE_VALUES, SLACK, Best, Ids, Table, alike, best_of, classes, column, matrix_of, met, others, packed
from tracewell.session import cut_lineage

FAN = 8
#: Rows of a leaf aimed at, rows of the sample, and the least number of sampled rows in a leaf.
LEAF = 2048
SAMPLE = 8192
SAMPLE_VALUES = 1 << 22
SAMPLED_LEAF = 8
#: Distances come from squares, so that small ones are known to this part of the lengths only.
ROUNDING = 1e-6
ANY = np.iinfo(np.int64).max


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    left, right = alike(left, right)
    squares = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1) - 2 * (left @ right.T)
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Node:
    points: np.ndarray
    #: Numbers of child nodes; a leaf n is -1 - n.
    children: list[int] = field(default_factory=list)


def _split_points(rows: np.ndarray, number: int) -> np.ndarray:
    """Rows far from each other: each the farthest from those before."""
    apart = distances(rows, rows.mean(axis=0)[None])[:, 0]
    chosen: list[int] = []
    for _ in range(number):
        far = int(apart.argmax())
        if chosen and apart[far] <= ROUNDING * (1 + np.abs(rows[far]).max(initial=0)):
            break
        fresh = distances(rows, rows[far][None])[:, 0]
        apart = np.minimum(apart, fresh) if chosen else fresh
        chosen.append(far)
    return rows[chosen]


def fit(sample: np.ndarray, leaf: int, fan: int = FAN) -> list[Node]:
    """The nodes of a tree whose leaves hold about ``leaf`` rows of the sample, parents first; none for a single leaf."""
    nodes: list[Node] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        points = _split_points(rows, min(fan, max(2, len(rows) // leaf))) if len(rows) > leaf else rows[:0]
        if len(points) < 2:
            leaves += 1
            return -leaves
        number = len(nodes)
        nodes.append(Node(points))
        nearest = distances(rows, points).argmin(axis=1)
        nodes[number].children = [grow(rows[nearest == j]) for j in range(len(points))]
        return number

    if len(sample):
        grow(sample.astype(np.float64))
    return nodes


def route(nodes: list[Node], rows: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The leaf of each row, and for every node (number, its rows, their distances to its split points, their subtree)."""
    at = np.zeros(len(rows), np.int64) if nodes else np.full(len(rows), -1)
    steps = []
    for number, node in enumerate(nodes):
        own = np.flatnonzero(at == number)
        if len(own):
            apart = distances(rows[own], node.points)
            nearest = apart.argmin(axis=1)
            at[own] = np.array(node.children)[nearest]
            steps.append((number, own, apart, nearest))
    return -1 - at, iter(steps)


@dataclass
class Ranges:
    """By node: low and high [split point, subtree], the least and largest length of a row in each subtree."""

    low: dict[int, np.ndarray]
    high: dict[int, np.ndarray]
    shortest: dict[int, np.ndarray]
    longest: dict[int, np.ndarray]

    @classmethod
    def empty(cls, nodes: list[Node]) -> Ranges:
        sizes = {k: len(n.points) for k, n in enumerate(nodes)}
        return cls(*({k: np.full(shape(m), start) for k, m in sizes.items()} for shape, start in (
            (lambda m: (m, m), np.inf), (lambda m: (m, m), -np.inf), (lambda m: m, np.inf), (lambda m: m, -np.inf))))

    def add(self, number: int, apart: np.ndarray, subtree: np.ndarray, norms: np.ndarray) -> None:
        for j in np.unique(subtree).tolist():
            own = subtree == j
            self.low[number][:, j] = np.minimum(self.low[number][:, j], apart[own].min(axis=0))
            self.high[number][:, j] = np.maximum(self.high[number][:, j], apart[own].max(axis=0))
            self.shortest[number][j] = min(self.shortest[number][j], norms[own].min())
            self.longest[number][j] = max(self.longest[number][j], norms[own].max())


def reached(nodes: list[Node], ranges: Ranges, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves, each with the questions whose window of scores ``low`` to ``high`` it may meet."""
    if not nodes:
        yield 0, np.arange(len(rows))
        return
    norms = np.sqrt((rows * rows).sum(axis=1))
    low, high = low.astype(np.float64), high.astype(np.float64)
    pending = [(0, np.arange(len(rows)))]
    while pending:
        number, own = pending.pop()
        node = nodes[number]
        apart, norm = distances(rows[own], node.points), norms[own]
        sizes = np.sqrt((node.points * node.points).sum(axis=1))
        for j, child in enumerate(node.children):
            shortest, longest = ranges.shortest[number][j], ranges.longest[number][j]
            if longest < shortest:
                continue  # no row is there
            outer = np.sqrt(np.maximum(norm ** 2 + longest ** 2 - 2 * low[own], 0))
            inner = np.sqrt(np.maximum(norm ** 2 + shortest ** 2 - 2 * high[own], 0))
            slack = ROUNDING * (1 + norm + longest + sizes.max())
            least, most = ranges.low[number][:, j], ranges.high[number][:, j]
            near = np.maximum(apart - most, least - apart).max(axis=1) <= outer + slack
            far = (apart + most).min(axis=1) >= inner - slack
            fits = near & far & (norm * longest * (1 + SLACK) >= low[own])
            if fits.any():
                if child < 0:
                    yield -1 - child, own[fits]
                else:
                    pending.append((child, own[fits]))


SAME, OTHER = 0, 1


def leaf_answerer(k: int, kind: int):
    """Exact answers of a leaf: the k best scores within each question's window, of rows with its label or of the others."""
    def build(rows: pa.Table):
        matrix = matrix_of(column(rows, "vec"))
        labels = column(rows, "label").to_numpy()
        order = np.argsort(labels, kind="stable")
        table, labels, ids = Table(matrix[order]), labels[order], Ids(column(rows, "ids").take(pa.array(order)))
        every = np.arange(len(labels))

        def answer(asked: pa.RecordBatch) -> pa.RecordBatch:
            questions = matrix_of(asked.column("vec"))
            wanted, high = asked.column("label").to_numpy(), asked.column("high").to_numpy()
            best = Best(k, asked.column("low").to_numpy())
            longest = Table(questions).longest
            for label in np.unique(wanted).tolist():
                own = np.flatnonzero(wanted == label)
                begin, end = np.searchsorted(labels, [label, label + 1])
                taken = every[begin:end] if kind == SAME else np.concatenate([every[:begin], every[end:]])
                if not len(taken):
                    continue
                for some in np.array_split(own, -(-len(own) // 512)):
                    scores = table.products(slice(begin, end) if kind == SAME else taken, questions[some], longest)
                    within = scores <= high[some].astype(scores.dtype)[:, None]
                    within &= scores >= best.floor[some].astype(scores.dtype)[:, None]
                    best.raise_to(some, np.where(within, scores, NONE if scores.dtype == np.int64 else -np.inf))
                    within &= scores >= best.floor[some].astype(scores.dtype)[:, None]
                    place, rows_ = np.nonzero(within)
                    best.offer(*ids.spread(some[place], taken[rows_], scores[place, rows_]))
            return best.answer(asked.column("ref").to_numpy())

        return answer

    return build


class Tree:
    """The tree over all rows (vec, label, norm, ids): its nodes and ranges here, its leaves as rows in the shared folder."""

    def __init__(self, rows: DataFrame, leaf: int = LEAF, sample: int = SAMPLE):
        rows = cut_lineage(rows)
        drawn, values = [], 0
        for row in rows.orderBy(F.xxhash64("vec"), "vec").select("vec").limit(sample).toLocalIterator():
            values += len(row.vec) // 2 + 1
            if len(drawn) > 1 and values > SAMPLE_VALUES:
                break
            drawn.append(bytes(row.vec))
        total = rows.count()
        share = max(SAMPLED_LEAF if total > len(drawn) else 1, -(-leaf * len(drawn) // max(1, total)))
        self.nodes = nodes = fit(matrix_of(drawn).astype(np.float64) if drawn else np.zeros((0, 0)), share)
        fields = rows.schema

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf_of = route(nodes, matrix_of(batch.column("vec")).astype(np.float64))[0] if batch.num_rows else np.zeros(0, np.int64)
                yield batch_of({"leaf": (pa.int64(), leaf_of)} | {n: (batch.schema.field(n).type, batch.column(n)) for n in batch.schema.names})

        self.rows = cut_lineage(rows.mapInArrow(routed, "leaf long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)))
        self.ranges = self._ranges()
        sizes = self.rows.groupBy("leaf").agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("size")).toArrow()
        # A large leaf is dealt over several places, each of a bounded size.
        self.parts = {leaf: max(1, -(-n // PLACE_ROWS), -(-n * size // (2 * PLACE_VALUES))) for leaf, n, size in zip(*(sizes.column(c).to_pylist() for c in ("leaf", "n", "size")))}

    def _ranges(self) -> Ranges:
        nodes = self.nodes
        ranges = Ranges.empty(nodes)
        if not nodes:
            return ranges

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Ranges.empty(nodes)
            for batch in batches:
                norms = batch.column("norm").to_numpy()
                for number, rows, apart, subtree in route(nodes, matrix_of(batch.column("vec")).astype(np.float64))[1] if batch.num_rows else ():
                    own.add(number, apart, subtree, norms[rows])
            found = [(k, i, j, own.low[k][i, j], own.high[k][i, j], own.shortest[k][j], own.longest[k][j])
                     for k, node in enumerate(nodes) for j in np.flatnonzero(own.longest[k] >= own.shortest[k]).tolist() for i in range(len(node.points))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 7, [pa.int64()] * 3 + [pa.float64()] * 4)],
                                             names=["node", "i", "j", "low", "high", "shortest", "longest"])

        partial = self.rows.select("vec", "norm").mapInArrow(seen, "node long, i long, j long, low double, high double, shortest double, longest double")
        # At most SAMPLE nodes with FAN x FAN numbers each, whatever the number of rows.
        for r in partial.groupBy("node", "i", "j").agg(F.min("low"), F.max("high"), F.min("shortest"), F.max("longest")).toLocalIterator():
            ranges.low[r[0]][r[1], r[2]], ranges.high[r[0]][r[1], r[2]] = r[3], r[4]
            ranges.shortest[r[0]][r[2]], ranges.longest[r[0]][r[2]] = r[5], r[6]
        return ranges

    def ask(self, asked: DataFrame, k: int, kind: int, home: bool | None = None) -> DataFrame:
        """The best answers (ref, id, score) for questions (ref, vec, label, low, high).

        ``home`` True sends a question to the leaf of its own vector alone, False to all others that
        its window may meet; None to all of them.
        """
        nodes, ranges, parts = self.nodes, self.ranges, self.parts

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = matrix_of(batch.column("vec")).astype(np.float64)
                own = route(nodes, rows)[0]
                low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
                found = ((leaf, np.flatnonzero(own == leaf)) for leaf in np.unique(own).tolist()) if home else (
                    (leaf, taken[own[taken] != leaf] if home is False else taken) for leaf, taken in reached(nodes, ranges, rows, low, high))
                for leaf, taken in found:
                    n = len(taken)
                    chosen = batch.take(pa.array(taken)) if n else None
                    for part in range(parts.get(leaf, 0) if n else 0):
                        yield batch_of({"place": (pa.int64(), np.full(n, leaf << 32 | part)), "kind": (pa.int32(), np.ones(n, np.int32)), "sorter": (pa.float64(), np.zeros(n)),
                                        "ref": (pa.int64(), chosen.column("ref")), "label": (pa.int64(), chosen.column("label")), "vec": (pa.binary(), chosen.column("vec")),
                                        "ids": (pa.list_(pa.int64()), pa.nulls(n, pa.list_(pa.int64()))), "low": (pa.int64(), chosen.column("low")), "high": (pa.int64(), chosen.column("high"))})

        count = F.create_map(*[F.lit(int(x)) for pair in self.parts.items() for x in pair])[F.col("leaf")] if self.parts else F.lit(1)
        part = F.pmod(F.xxhash64("vec", "label"), count)
        kept = self.rows.select((F.shiftleft("leaf", 32) + part).alias("place"), F.lit(0).alias("kind"), F.lit(0.0).alias("sorter"), F.lit(None).cast("long").alias("ref"),
                                "label", "vec", "ids", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
        sent = asked.select("ref", "vec", "label", "low", "high").mapInArrow(send, MET)
        return met(kept.unionByName(sent), leaf_answerer(k, kind))

    def best(self, asked: DataFrame, k: int, kind: int) -> DataFrame:
        """The k best (ref, rank, id, score): first of each question's own leaf, whose k-th score narrows its window for the others."""
        near = cut_lineage(best_of(self.ask(asked, k, kind, home=True), k))
        kth = near.where(F.col("rank") == k).select(F.col("ref").alias("held"), F.col("score").alias("least"))
        narrow = asked.join(kth, F.col("ref") == F.col("held"), "left").withColumn("low", F.greatest("low", "least"))
        far = self.ask(narrow, k, kind, home=False)
        return best_of(near.select("ref", "id", "score").unionByName(far), k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
                   id_col: str = "vec_id", vector_col: str = "embedding", leaf: int = LEAF) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are floor(256 * x), a score is the inner product with the anchor, higher ones come first
    and ties by smaller id. An anchor's positives are its first rows of the same label; for each of them the
    first rows of other labels with least * positive <= 100 * negative <= most * positive are returned.

    No part take rows with a NULL label, id or vector, a NULL or non-finite component, or a squared length of
    2**62 or more. A vector of fewer components than another counts as filled up with zeros. A row that
    repeats an id, vector and label counts once; different rows under one id are rows of their own, also for
    each other. An empty table gives no rows; other columns are ignored.
    """
    def own(df: DataFrame) -> DataFrame:
        return packed(df, id_col, vector_col, label).where("label IS NOT NULL")

    anchors = cut_lineage(own(rows.where(is_anchor)).distinct())
    asked = cut_lineage(anchors.groupBy("vec", "label").agg(F.first("norm").alias("norm")).withColumn("ref", F.monotonically_increasing_id()))
    tree = Tree(classes(own(rows), positives + 1), leaf)
    # For all anchors with one vector and label, one positive more than asked: one may be the anchor itself.
    near = tree.best(asked.withColumn("low", F.lit(NONE)).withColumn("high", F.lit(ANY)), positives + 1, SAME)
    near = cut_lineage(near.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found")))
    named = anchors.join(asked.select("vec", "label", "ref"), ["vec", "label"]).join(near, "ref")
    pairs = named.select("ref", F.col("id").alias("anchor_id"), F.explode(others("found", "id", "square", positives)).alias("positive")).select(
        "ref", "anchor_id", F.col("positive.id").alias("positive_id"), F.col("positive.score").alias("positive_score"))
    # Windows of whole scores; a negative positive score leaves none.
    score = F.col("score").cast("decimal(20,0)")
    windows = near.select("ref", F.explode("found.score").alias("score")).distinct().withColumn("low", F.ceil(score * least / 100).cast("long")).withColumn(
        "high", F.floor(score * most / 100).cast("long")).where("low <= high")
    windows = cut_lineage(windows.join(asked.select("ref", "vec", "label"), "ref").withColumnRenamed("ref", "anchor").withColumn("ref", F.monotonically_increasing_id()))
    found = tree.best(windows, negatives, OTHER).select("ref", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    answers = windows.select("ref", F.col("anchor").alias("asked"), F.col("score").alias("positive_score")).join(found, "ref").drop("ref")
    matched = pairs.withColumnRenamed("ref", "asked").join(answers, ["asked", "positive_score"])
    return matched.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
