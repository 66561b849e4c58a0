"""Greedy packing of ordered items into windows.

The one sequential step of chunking. It sees only the item sizes of one document row and
returns positions, so texts and tables stay in the JVM.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.spans import list_column

WINDOWS = T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer"))


def pack(costs: list[int], limit: int, *, scopes: list | None = None, carry_cost: int = 0, carry_items: int = 0) -> list[tuple[int, int]]:
    """Half-open windows whose cost stays within ``limit`` (a single larger item stands alone).

    A change of scope always starts a new window. After an overflow the next window begins
    with trailing items of the previous one: up to ``carry_cost`` (but at least one item), or
    the last ``carry_items`` items.
    """
    total = [0, *accumulate(costs)]
    edges = [0] + [i for i in range(1, len(costs)) if scopes is not None and scopes[i] != scopes[i - 1]] + [len(costs)]
    out: list[tuple[int, int]] = []
    for first, last in zip(edges, edges[1:]):
        start, least = first, first + 1
        while start < last:
            stop = min(last, max(least, bisect_right(total, total[start] + limit) - 1))
            out.append((start, stop))
            if stop == last:
                break
            if carry_cost:
                back = min(stop - 1, bisect_left(total, total[stop] - carry_cost))
            else:
                back = stop - carry_items
            start, least = max(start, back), stop + 1
    return out


def _column(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return list_column(rows, ["start", "stop"], [pa.int32(), pa.int32()])


def pack_blocks(limit: int, carry_cost: int):
    """UDF (costs, scopes) -> windows for text blocks."""

    @F.arrow_udf(WINDOWS)
    def run(costs: pa.Array, scopes: pa.Array) -> pa.Array:
        both = zip(costs.to_pylist(), scopes.to_pylist())
        return _column([pack(c or [], limit, scopes=s, carry_cost=carry_cost) for c, s in both])

    return run.asNondeterministic()  # or the optimizer copies it into a filter below


def pack_rows(limit: int, carry_items: int):
    """UDF costs -> windows for table rows."""

    @F.arrow_udf(WINDOWS)
    def run(costs: pa.Array) -> pa.Array:
        return _column([pack(c or [], limit, carry_items=carry_items) for c in costs.to_pylist()])

    return run.asNondeterministic()  # or the optimizer copies it into a filter below
