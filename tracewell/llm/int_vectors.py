"""Vectors of whole numbers for the search operators: packing, exact products, places where questions meet rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.common import batch_of, prepare

SCALE = 256
#: Squared lengths from here on could give scores beyond a long.
LIMIT = 2.0 ** 62
NONE = np.iinfo(np.int64).min
#: Numbers that a place holds at most: 65,536 rows of 64.
PLACE_VALUES = 1 << 22
PLACE_ROWS = 1 << 16
SLACK = 1e-9

MET = "place long, kind int, sorter double, ref long, label long, vec binary, ids array<long>, low long, high long"
ANSWER = "ref long, id long, score long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        with np.errstate(over="ignore"):
            values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bad = np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) > 0
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.bincount(owner, np.where(np.isfinite(values), values, 0.0) ** 2, minlength=len(sizes))
        kept = np.flatnonzero(~bad & (squares < LIMIT))
        packed, square = [], []
        for k in kept.tolist():
            own = values[starts[k]:ends[k]].astype(np.int64)
            most = int(np.abs(own).max()) if len(own) else 0
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            packed.append(bytes([width]) + own.astype(f"<i{width}").tobytes())
            square.append(int(own @ own))
        taken = pa.array(kept)
        rest = {n: (batch.schema.field(n).type, batch.column(n).take(taken)) for n in batch.schema.names[2:]}
        yield batch_of({"id": (pa.int64(), batch.column(0).take(taken)), "vec": (pa.binary(), packed), "norm": (pa.float64(), np.sqrt(squares[kept])), "square": (pa.int64(), square)} | rest)


def packed(rows: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """Rows (id, vec, norm, square, label): every component as floor(256 * x), packed by its width, and the length.

    Left out are rows with a NULL id, a NULL vector, a NULL or non-finite component, or a squared
    length of 2**62 or more, since a score of theirs may not fit a long.
    """
    prepare(rows.sparkSession)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"),
                      (F.lit(None) if label is None else label).cast("long").alias("label"))
    return own.where("id IS NOT NULL AND x IS NOT NULL").mapInArrow(_pack, "id long, vec binary, norm double, square long, label long")


def matrix_of(column: pa.Array | Sequence[bytes], width: int = 0) -> np.ndarray:
    """The vectors of packed rows as a matrix of longs; shorter ones are filled up with zeros."""
    held = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    sizes = {(len(x), x[0]) for x in held}
    if len(sizes) == 1:
        (size, kind), = sizes
        values = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), size)[:, 1:]
        whole = np.ascontiguousarray(values).view(f"<i{kind}").astype(np.int64).reshape(len(held), -1)
    else:
        rows = [np.frombuffer(x, f"<i{x[0]}", offset=1) for x in held]
        whole = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
        for k, own in enumerate(rows):
            whole[k, :len(own)] = own
    return np.pad(whole, ((0, 0), (0, max(0, width - whole.shape[1]))))


def alike(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with the same number of columns, zeros added."""
    width = max(left.shape[1], right.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (left, right))


def lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))


class Table:
    """Vectors with exact products: in floats as long as all partial sums are whole numbers that these hold."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.norms = matrix, lengths(matrix)
        self.longest = float(self.norms.max(initial=0.0))
        self._as: dict[type, np.ndarray] = {}

    def products(self, rows: slice | np.ndarray, others: np.ndarray, others_longest: float) -> np.ndarray:
        bound = self.longest * others_longest * (1 + SLACK) + 1
        most = max(self.longest, others_longest)
        kind = np.float32 if bound < 1 << 24 and most < 1 << 24 else np.float64 if bound < 1 << 53 and most < 1 << 53 else np.int64
        if kind not in self._as:
            self._as[kind] = self.matrix.astype(kind)
        own, width = self._as[kind][rows], others.shape[1]
        shared = min(width, own.shape[1])
        return others[:, :shared].astype(kind) @ own[:, :shared].T


class Ids:
    """The ids of each row of a table; rows stand for all that share a vector."""

    def __init__(self, lists: pa.ListArray):
        self.count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = lists.flatten().to_numpy()
        self.first = np.cumsum(self.count) - self.count

    def spread(self, asked: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number = self.count[rows]
        own = np.repeat(np.arange(len(rows)), number)
        place = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
        return asked[own], scores[own].astype(np.int64), self.flat[self.first[rows][own] + place]


class Best:
    """The k highest scores of each question, ties by smaller id; ``floor`` is what a further one must reach."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.int64)
        self.rows = self.scores = self.ids = np.zeros(0, np.int64)

    def raise_to(self, asked: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` are of different rows for each of the questions ``asked``: the k-th is a floor."""
        if scores.shape[1] >= self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            held = np.isfinite(kth)
            self.floor[asked[held]] = np.maximum(self.floor[asked[held]], kth[held].astype(np.int64))

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        rows, scores, ids = (np.concatenate(x) for x in ((self.rows, rows), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        kept = place < self.k
        last = place == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last])
        self.rows, self.scores, self.ids = rows[kept], scores[kept], ids[kept]

    def answer(self, refs: np.ndarray) -> pa.RecordBatch:
        return batch_of({"ref": (pa.int64(), refs[self.rows]), "id": (pa.int64(), self.ids), "score": (pa.int64(), self.scores)})


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Rows (vec, label, norm, ids): one for all rows that share vector and label, with their ``k`` smallest ids.

    No further id of a class can be among the best ``k`` of any question. A row that repeats an id, its
    vector and label counts once. Spark trims every task to k rows a class before its rows are dealt.
    """
    once = rows.groupBy("vec", "label", "id").agg(F.first("norm").alias("norm"))
    place = F.row_number().over(Window.partitionBy("vec", "label").orderBy("id"))
    return once.withColumn("place", place).where(F.col("place") <= k).groupBy("vec", "label").agg(
        F.first("norm").alias("norm"), F.sort_array(F.collect_list("id")).alias("ids"))


Answerer = Callable[[pa.RecordBatch], pa.RecordBatch]


def met(spread: DataFrame, build: Callable[[pa.Table], Answerer]) -> DataFrame:
    """Answers (ref, id, score) of ``build(rows of a place)(questions of the place)``.

    ``spread`` has the columns of ``MET``: rows of kind 0 and questions of kind 1. A place's rows,
    bounded by who dealt them, are held in its task; its questions pass by in batches.
    """
    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, answer = None, [], None
        for batch in batches:
            place, kind = batch.column("place").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                if begin == end:
                    continue
                if place[begin] != now:
                    now, held, answer = place[begin], [], None
                part = batch.slice(begin, end - begin)
                if kind[begin] == 0:
                    held.append(part)
                    continue
                if answer is None and held:
                    answer, held = build(pa.Table.from_batches(held).combine_chunks()), []
                if answer is not None:
                    yield answer(part)

    parts = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(parts, "place").sortWithinPartitions("place", "kind", "sorter", "vec").mapInArrow(answered, ANSWER)


def best_of(answers: DataFrame, k: int) -> DataFrame:
    """The k best (rank, id, score) of each ref; a ref has at most k answers from a place, trimmed before they are dealt."""
    order = Window.partitionBy("ref").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def others(found: str, own: str, square: str, k: int) -> Column:
    """The first k of the structs (rank, id, score) but for the row's own, which has its id and the square of its vector as score."""
    listed = F.transform(F.sort_array(found), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    at = F.array_position(listed, F.struct(F.col(own).alias("id"), F.col(square).alias("score")))
    return F.slice(F.filter(listed, lambda x, place: place + 1 != at), 1, k)


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
