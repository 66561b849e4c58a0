"""Lookups within one document row by hash sets and maps, which array expressions lack.

They see only the keys of one row and return positions or titles; texts and tables stay in the JVM.
Declared nondeterministic, though they are not: the optimizer would otherwise copy them, and whatever
they are made of, into filters below and into lambdas, where they would run for every element.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.spans import list_column


def _once(run):
    return run.asNondeterministic()


@_once
@F.arrow_udf(T.ArrayType(T.IntegerType()))
def positions_outside(keys: pa.Array, boxes: pa.Array, excluded: pa.Array, furniture: pa.Array) -> pa.Array:
    """Positions whose key is not excluded and whose box is no furniture."""
    out = []
    for k, b, no, fixed in zip(*(c.to_pylist() for c in (keys, boxes, excluded, furniture))):
        no, fixed = set(no or []), set(fixed or [])
        out.append([i for i, (x, y) in enumerate(zip(k or [], b or [])) if x not in no and y not in fixed])
    return list_column(out, None, [pa.int32()])


def paths_from(ids: list, parents: list, titles: list, starts: list) -> list[list[str]]:
    """Titles from the root to every start; cycles and gaps end the walk, of equal ids the last counts."""
    place = {x: i for i, x in enumerate(ids) if x}
    known: dict = {}
    for start in starts:
        if start in known:
            continue
        path, seen, at = [], set(), start
        while at in place and at not in seen:
            seen.add(at)
            if titles[place[at]]:
                path.append(titles[place[at]])
            at = parents[place[at]]
        known[start] = path[::-1]
    return [known[s] for s in starts]


@_once
@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def heading_paths(ids: pa.Array, parents: pa.Array, titles: pa.Array, starts: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (ids, parents, titles, starts)))
    return list_column([paths_from(i or [], p, t, s or []) for i, p, t, s in rows], None, [pa.list_(pa.string())])
