"""Searches in vectors of whole numbers against plain comparison of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hyperplane_tree as h, int_vectors as v, norm_buckets as n

ROWS = "vec_id long, embedding array<double>, label int"


def whole(x):
    return None if x is None or any(c is None or not math.isfinite(c) for c in x) else [math.floor(256 * c) for c in x]


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


def distinct(rows, labelled=False):
    held = {(i, tuple(whole(x)), l) for i, x, l in rows if i is not None and whole(x) is not None and (l is not None or not labelled)}
    return [(i, x, l) for i, x, l in held if score(x, x) < 2 ** 62]


def plain_top(rows, every, k):
    own = {(i, x) for i, x, _ in distinct(rows)}
    found = []
    for i, x in own:
        if i % every == 0:
            best = sorted((-score(x, y), j) for j, y in own if (j, y) != (i, x))[:k]
            found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(found)


def plain_negatives(rows, every):
    own = distinct(rows, True)
    found = []
    for i, x, l in own:
        if i % every:
            continue
        for s, j in sorted((-score(x, y), j) for j, y, m in own if m == l and (j, y) != (i, x))[:5]:
            s = -s
            far = sorted((-score(x, y), j2) for j2, y, m in own if m != l and 50 * s <= 100 * score(x, y) <= 95 * s)[:3]
            found += [(i, j, r + 1, j2, s, -t) for r, (t, j2) in enumerate(far)]
    return sorted(found)


def clustered(seed, count, size, scale=lambda r: 1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    return [(k, [scale(r) * (c + r.gauss(0, 0.15)) for c in r.choice(centres)], r.randrange(3)) for k in range(count)]


def hot(seed):
    """A third of the rows share one vector, further ones nearly."""
    r = random.Random(seed)
    one = [0.5, -0.25, 0.125, 0.7]
    return [(k, list(one) if k % 3 == 0 else [c + r.uniform(-.02, .02) for c in one] if k % 3 == 1 else [r.gauss(0, 1) for _ in one], k % 2) for k in range(240)]


ODD = [(None, [1.0, 2.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [1.0, float("nan")], 0), (40, [float("inf"), 0.0], 0), (50, [], 1), (60, [1.0], 1), (70, [0.5, 0.5, 0.5], 1),
       (80, [0.0, 0.0], 0), (90, [-1.0, -2.0], 0), (100, [1.0, 1.0], None), (110, [1e300, 1.0], 0), (120, [3e5, -2e6], 0), (130, [2e5, 1e6], 0), (60, [1.0], 1), (60, [2.0], 0), (61, [1.0], 1)]

CASES = {"clusters": clustered(1, 220, 6), "lengths": clustered(2, 220, 5, lambda r: math.exp(r.gauss(0, 2))), "long vectors": clustered(3, 80, 70), "hot": hot(4), "odd": ODD,
         "wide numbers": clustered(5, 80, 4, lambda r: 10 ** r.uniform(0, 5)), "none": []}


@pytest.mark.parametrize("case", CASES)
def test_top_products_equal_plain_comparison(spark, case, monkeypatch):
    monkeypatch.setattr(n, "BUCKET", 16)
    monkeypatch.setattr(n, "SEEDS", 7)
    rows = CASES[case]
    table = spark.createDataFrame(rows, ROWS).withColumn("score", F.lit("x")).withColumn("ref", F.lit(None).cast("int")).withColumn("vec", F.lit(1))
    found = n.top_products(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 10, 5)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


@pytest.mark.parametrize("case", CASES)
def test_hard_negatives_equal_plain_comparison(spark, case):
    rows = CASES[case]
    table = spark.createDataFrame(rows, ROWS).withColumn("norm", F.lit("x")).withColumn("leaf", F.lit(None).cast("int")).withColumn("found", F.lit(1))
    found = h.hard_negatives(table, F.col("vec_id") % 10 == 0, F.col("label"), leaf=20)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 10)
    assert found.dtypes[2] == ("rank", "int") and {d for _, d in found.dtypes} == {"bigint", "int"}


def test_float32_components_are_scaled_as_doubles(spark):
    x = [np.float32(v) for v in (0.1, 0.30000001, -0.00390625, 1e-9, -1e-9)]
    table = spark.createDataFrame([(1, [float(v) for v in x])], "vec_id long, embedding array<float>")
    row = v.packed(table, "vec_id", "embedding").first()
    assert v.matrix_of([bytes(row.vec)]).tolist() == [[math.floor(256 * float(c)) for c in x]]


def test_packing_keeps_all_widths():
    rows = [bytes([2]) + np.array([-5, 7], "<i2").tobytes(), bytes([8]) + np.array([2 ** 30 + 1], "<i8").tobytes() * 1, bytes([4])]
    assert v.matrix_of(rows).tolist() == [[-5, 7], [2 ** 30 + 1, 0], [0, 0]]


def test_each_way_of_pruning_is_taken(monkeypatch):
    monkeypatch.setattr(n, "BUCKET", 40)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16) * 200

    def of_length(x):
        return np.rint(800 * x / v.lengths(x)[:, None]).astype(np.int64)

    near, wide = of_length(centre + rng.normal(size=(300, 16)) * 2), of_length(rng.normal(size=(700, 16)))
    rows = np.concatenate([near, wide, wide // 50])
    rows = rows[np.argsort(-v.lengths(rows), kind="stable")]
    import pyarrow as pa
    ids = v.Ids(pa.array([[k] for k in range(len(rows))], pa.list_(pa.int64())))
    counts: dict[str, int] = {}
    questions = np.concatenate([near[:3], wide[:3]])
    best = v.Best(4, np.full(6, v.NONE))
    n.best_in(n.buckets_of(rows, v.lengths(rows)), ids, questions, best, counts)
    want = [sorted((-int(s), k) for k, s in enumerate(rows @ q))[:4] for q in questions]
    assert [[(-s, i) for r, s, i in zip(best.rows, best.scores, best.ids) if r == k] for k in range(6)] == want
    assert 0 < counts["coordinate"] < 3 * len(rows) and 0 < counts["length"] < 6 * len(rows)


def test_tree_leaves_siblings_out_and_loses_none():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 300
    rows = np.rint(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 10)
    nodes = h.fit(rows[::8], 20)
    leaf, steps = h.route(nodes, rows)
    ranges, norms = h.Ranges.empty(nodes), v.lengths(rows)
    for number, own, apart, subtree in steps:
        ranges.add(number, apart, subtree, norms[own])
    questions = rows[:40]
    scores = questions @ rows.T
    best = np.sort(scores, axis=1)[:, -5]
    for low, high in ((best, np.full(40, 2.0 ** 62)), (best * 0.5, best * 0.6)):
        met = {(q, l) for l, taken in h.reached(nodes, ranges, questions, low, high) for q in taken.tolist()}
        inside = (scores >= low[:, None]) & (scores <= high[:, None])
        assert {(q, int(leaf[r])) for q, r in zip(*np.nonzero(inside))} <= met
        if high[0] > 1e18:
            assert len(met) < 0.3 * 40 * len(set(leaf.tolist()))


def test_a_large_leaf_is_dealt_over_places(spark, monkeypatch):
    monkeypatch.setattr(h, "PLACE_ROWS", 15)
    rows = hot(6)
    found = h.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0, F.col("label"), leaf=100)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 10)


def test_a_place_has_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(n, "PLACE_ROWS", 10)
    rows = CASES["lengths"]
    assert sorted(map(tuple, n.top_products(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0).collect())) == plain_top(rows, 10, 5)
