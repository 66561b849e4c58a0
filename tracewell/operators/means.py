"""Means of vectors per owner from sums that merge: one row per owner and task is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.vectors import l2_normalize

#: Numbers that a task holds before it hands its sums on.
HELD_VALUES = 1 << 21


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of every number of a list column; NULL lists have none, NULL numbers are nan."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, place, lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)


class _Sums:
    """Sums and counts per owner and dimension."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.held, self.values = kind, {}, 0

    def add(self, owners: pa.Array, row: np.ndarray, place: np.ndarray, value: np.ndarray, number: np.ndarray) -> None:
        coded = owners.dictionary_encode(null_encoding="encode")
        names, width = coded.dictionary.to_pylist(), int(place.max(initial=-1)) + 1
        cell = coded.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64) * width + place
        shape = (len(names), width)
        sums = np.bincount(cell, value, minlength=shape[0] * width).reshape(shape)
        counts = np.bincount(cell, number, minlength=shape[0] * width).reshape(shape)
        present = np.zeros(len(names), bool)
        present[coded.indices.to_numpy(zero_copy_only=False)[row]] = True
        for name, own, n, there in zip(names, sums, counts, present):
            if not there:
                continue
            old = self.held.get(name)
            if old is None:
                self.held[name] = [own.copy(), n.copy()]
                self.values += 2 * width
                continue
            if len(old[0]) < width:
                old[:] = [np.pad(x, (0, width - len(x))) for x in old]
            old[0][:width] += own
            old[1][:width] += n

    def rows(self, but: object = None, keep: bool = False) -> pa.RecordBatch:
        """All that is held, or all except the owner ``but``, which stays."""
        kept = {but: self.held.pop(but)} if keep and but in self.held else {}
        ends = [len(np.trim_zeros(counts, "b")) for _, counts in self.held.values()]
        sums, counts = ([x[side][:end] for x, end in zip(self.held.values(), ends)] for side in (0, 1))
        out = pa.RecordBatch.from_arrays([pa.array(list(self.held), self.kind), pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.float64()))],
                                         names=["owner", "sums", "counts"])
        self.held, self.values = kept, sum(2 * len(x[0]) for x in kept.values())
        return out


def vector_sums(vectors: DataFrame, owner: str, vector: str) -> DataFrame:
    """Rows (owner, sums, counts), at most one per owner, task and ``HELD_VALUES`` numbers."""
    kind = vectors.schema[owner].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            sums = sums or _Sums(batch.schema.field(0).type)
            row, place, value = _flat(batch.column(1))
            known = ~np.isnan(value) | (pc.is_valid(batch.column(1).flatten()).to_numpy(zero_copy_only=False))
            sums.add(batch.column(0), row, place, np.where(known, value, 0.0), known.astype(np.float64))
            if sums.values > HELD_VALUES:
                yield sums.rows()
        if sums and sums.held:
            yield sums.rows()

    return vectors.select(F.col(owner).alias("owner"), F.col(vector).alias("vector")).mapInArrow(partial, f"owner {kind}, sums array<double>, counts array<double>")


def merged_sums(sums: DataFrame) -> DataFrame:
    """One row (owner, sums, counts) per owner; a task holds one batch and the owner that goes on behind it."""
    kind = sums.schema["owner"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = held or _Sums(batch.schema.field(0).type)
            row, place, value = _flat(batch.column(1))
            held.add(batch.column(0), row, place, value, _flat(batch.column(2))[2])
            yield held.rows(batch.column(0)[-1].as_py(), keep=True)
        if held:
            yield held.rows()

    return sums.repartition("owner").sortWithinPartitions("owner").mapInArrow(merge, f"owner {kind}, sums array<double>, counts array<double>")


def mean_vectors(vectors: DataFrame, owner: str, vector: str) -> DataFrame:
    """Rows (owner, mean, unit): the mean vector per owner and the same L2-normalised.

    NULL vectors and numbers are left out; vectors of one owner may differ in size, each dimension then
    has the mean of those that have it, and the mean ends with the last dimension that has a number.
    """
    whole = merged_sums(vector_sums(vectors, owner, vector))
    mean = F.zip_with("sums", "counts", lambda s, n: F.when(n > 0, s / n))
    return whole.select(F.col("owner").alias(owner), mean.alias("mean")).withColumn("unit", l2_normalize(F.col("mean")))
