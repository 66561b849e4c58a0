"""Rows and questions that meet in places of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Answerer = Callable[[pa.RecordBatch], pa.RecordBatch]


def meet(rows: DataFrame, asks: DataFrame, build: Callable[[pa.Table], Answerer], schema: str) -> DataFrame:
    """``build(rows of a place)(questions of that place, batch by batch)`` for every place, as rows of ``schema``.

    Both frames have a long column ``place`` and own columns besides. A task holds the rows of one place,
    whose number the caller bounds; any number of questions passes by.
    """
    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, answer = None, [], None
        for batch in batches:
            place, asking = batch.column("place").to_numpy(), batch.column("_asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(asking.astype(np.int8)) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                if begin == end:
                    continue
                if place[begin] != now:
                    now, held, answer = place[begin], [], None
                part = batch.slice(begin, end - begin)
                if not asking[begin]:
                    held.append(part)
                    continue
                if answer is None and held:
                    answer, held = build(pa.Table.from_batches(held).combine_chunks()), []
                if answer is not None:
                    yield answer(part)

    both = rows.withColumn("_asks", F.lit(False)).unionByName(asks.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "place").sortWithinPartitions("place", "_asks").mapInArrow(answered, schema)


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
