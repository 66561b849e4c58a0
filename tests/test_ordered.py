import random

from pyspark.sql import functions as F

from tracewell.operators.ordered import ordered_columns
from tracewell.operators.topk import first_rows, top_k


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # One key holds most rows; another key is NULL.
        key = rng.choice(["hot"] * 6 + ["b", "c", None])
        out.append((key, rng.randint(0, 20), i, rng.choice([None, "x", "y", "z"]), rng.randint(1, 9)))
    return out


def expected(data, descending):
    out = {}
    for key in {r[0] for r in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: ((-r[1] if descending else r[1]), r[2]))
        total, carry, before = 0, None, None
        for n, r in enumerate(group, 1):
            total += r[4]
            carry = r[3] if r[3] is not None else carry
            out[r[2]] = (n, before, total, carry)
            before = r[3]
    return out


def test_hot_groups_equal_plain_windows(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o int, id long, v string, c int").repartition(7)
    for descending in (False, True):
        want = expected(data, descending)
        for bounded in (True, False):  # plain windows, then the segmented way
            got = ordered_columns(df, ["k"], [("o", not descending), ("id", True)], number="n", lag={"before": "v"},
                                  running={"total": "c"}, carry={"last": "v"}, bounded=bounded).collect()
            assert len(got) == len(data)
            assert {r["id"]: (r["n"], r["before"], r["total"], r["last"]) for r in got} == want


def test_whole_table_as_one_group(spark):
    df = spark.range(500).withColumn("x", F.lit(2))
    got = ordered_columns(df, [], [("id", False)], number="n", running={"s": "x"}).collect()
    assert all(r["n"] == 500 - r["id"] and r["s"] == 2 * r["n"] for r in got)


def test_top_k_and_first_rows(spark):
    data = [("a", i % 7, i) for i in range(300)] + [("b", 1, 1000)]
    df = spark.createDataFrame(data, "k string, s int, id long")
    got = {(r["k"], r["rank"]): r["id"] for r in top_k(df, ["k"], [F.desc("s"), F.asc("id")], 5, "id").collect()}
    best = sorted((r for r in data if r[0] == "a"), key=lambda r: (-r[1], r[2]))[:5]
    assert got == {**{("a", n): r[2] for n, r in enumerate(best, 1)}, ("b", 1): 1000}
    firsts = {r["k"]: r["id"] for r in first_rows(df, ["k"], ["s", "id"]).collect()}
    assert firsts == {"a": 0, "b": 1000}
