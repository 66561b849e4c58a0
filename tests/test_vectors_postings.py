"""Vector means, token windows and stored postings against plain restatements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import vectors
from tracewell.operators import means, postings
from tracewell.operators.scoring import query_tokens, search


def test_means_merge_over_tasks_and_batches(spark, monkeypatch):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None, "c"]), [r.choice([None, r.uniform(-3, 3)]) if r.random() < .1 else r.uniform(-3, 3) for _ in range(r.choice([3, 3, 3, 5]))]) for _ in range(600)]
    rows += [("gone", None), ("empty", []), ("holes", [None, 1.0])]
    monkeypatch.setattr(means, "HELD_VALUES", 10)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = spark.createDataFrame(rows, "owner string, v array<double>").repartition(5)
        found = {x.owner: x["mean"] for x in means.mean_vectors(table, "owner", "v").collect()}
        partial = means.vector_sums(table.coalesce(1), "owner", "v").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for owner in {o for o, _ in rows}:
        cells = {}
        for o, v in rows:
            if o == owner:
                for k, x in enumerate(v or []):
                    cells.setdefault(k, []).append(x)
        if cells:
            while cells and all(x is None for x in cells[max(cells)]):
                del cells[max(cells)]
            want[owner] = [(lambda own: sum(own) / len(own) if own else None)([x for x in cells[k] if x is not None]) for k in sorted(cells)]
    assert found.keys() == want.keys() and partial < len(rows)
    for owner, mean in want.items():
        assert [None if x is None else round(x, 9) for x in found[owner]] == [None if x is None else round(x, 9) for x in mean]


def test_one_row_per_owner_and_task_is_shuffled(spark):
    table = spark.range(4000).select((F.col("id") % 3).alias("owner"), F.array(*[F.col("id") * 1.0] * 16).alias("v")).repartition(4)
    assert means.vector_sums(table, "owner", "v").count() == 12
    found = {x.owner: x["mean"][7] for x in means.mean_vectors(table, "owner", "v").collect()}
    assert found == {k: pytest.approx(sum(range(k, 4000, 3)) / len(range(k, 4000, 3))) for k in range(3)}


def test_windows_hold_every_token():
    for count in range(0, 60):
        for room, shared in ((8, 2), (5, 4), (7, 0)):
            spans = vectors.token_windows(count, room, shared)
            assert {t for b, e in spans for t in range(b, e)} == set(range(count)) and all(e - b <= room for b, e in spans)
            assert all(a[0] + room - shared == b[0] for a, b in zip(spans, spans[1:])) and (len(spans) == 1 or spans[-1][1] - spans[-1][0] > shared)
    with pytest.raises(ValueError):
        vectors.token_windows(3, 2, 2)


def test_long_texts_are_pooled_over_token_windows(spark):
    def load():
        table = np.random.default_rng(0).normal(size=(50, 6))
        return (lambda s: [(len(w) * 7 + ord(w[-1])) % 50 for w in s.split()]), lambda ids, mask: table[ids] + np.arange(ids.shape[1])[None, :, None] * 0.01

    texts = ["", None, "one two three", " ".join(f"word{k * k % 91}" for k in range(400)), "x " * 33]
    encode = vectors.window_encoder(load, room=16, shared=4, at_once=3)
    found = [x.v for x in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", encode("t").alias("v")).orderBy("k").collect()]
    tokens, model = load()
    for text, own in zip(texts, found):
        ids = tokens("passage: " + (text or ""))
        units = []
        for b, e in vectors.token_windows(len(ids), 16, 4):
            pooled = model(np.array([ids[b:e]]), None)[0].mean(axis=0)
            units.append(pooled / np.linalg.norm(pooled))
        mean = np.mean(units, axis=0)
        assert np.allclose(own, mean / np.linalg.norm(mean), atol=1e-6)


DOCS = "doc_id long, text string"


def texts(seed, number):
    r = random.Random(seed)
    tongues = [[f"{t}{w}" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")] for t in ("de", "fr", "en")]
    return [" ".join(r.choices(r.choice(tongues), weights=range(8, 0, -1), k=r.randint(0, 30))) for _ in range(number)]


def test_postings_equal_the_scan_and_read_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "FIRST", 1)
    rows = list(enumerate(texts(3, 300))) + [(1000, None), (1001, ""), (1002, "only here"), (1003, "only here"), (1004, "only here")]
    corpus = spark.createDataFrame(rows, DOCS)
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(["detheta deeta", "fralpha frtheta", "only", "", None, "unknown words", "enzeta enzeta enzeta entheta", "only here enalpha"])], "query_id string, text string")
    index = postings.Postings(spark, str(tmp_path / "p")).build(corpus, "doc_id", "text")
    key = lambda x: (x.query_id, x["rank"], x.id, round(x.score, 6))
    want = sorted(map(key, search(corpus, queries, k=4, by="lexical", doc=("doc_id", "text"), query=("query_id", "text")).collect()))
    assert sorted(map(key, index.search(queries, 4).collect())) == want
    work = {x.query_id: (x.postings, x.read) for x in index.work(queries, 4).collect()}
    assert all(read <= whole for whole, read in work.values()) and sum(read for _, read in work.values()) < 0.7 * sum(whole for whole, _ in work.values())


def test_posting_maxima_bound_their_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    rows = list(enumerate(texts(5, 100)))
    index = postings.Postings(spark, str(tmp_path / "p")).build(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    held = index._read().collect()
    sizes = {k: query_tokens(t) for k, t in rows}
    mean = sum(map(len, sizes.values())) / len(rows)
    assert sum(x.n for x in held) == sum(len(set(t)) for t in sizes.values()) and max(len({i for x in held if x.block == b for i in x.ids}) for b in {x.block for x in held}) <= 16
    for x in held:
        assert x.most == max(x.gains) and x.n == len(x.ids)
        for i, gain in zip(x.ids, x.gains):
            tf = sizes[i].count(x.term)
            assert math.isclose(gain, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(sizes[i]) / mean)), rel_tol=1e-9)


def test_an_empty_corpus_has_no_hits(spark, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "p")).build(spark.createDataFrame([], DOCS), "doc_id", "text")
    assert index.search(spark.createDataFrame([(1, "word")], "query_id long, text string"), 3).count() == 0


def plain_cosine(rows, queries, k):
    def unit(v):
        return np.array(v, float) / max(math.sqrt(sum(x * x for x in v)), 1e-12)

    found = []
    for q, w in queries:
        best = sorted((-round(float(unit(v) @ unit(w)), 9) + 0.0, i) for i, v in rows if v is not None)[:k]
        found += [(q, rank + 1, i, round(-s, 6) + 0.0) for rank, (s, i) in enumerate(best)]
    return sorted(found)


def test_clusters_equal_plain_comparison_and_leave_rings_out(spark, tmp_path, monkeypatch):
    from tracewell.operators import clusters
    monkeypatch.setattr(clusters, "PLACE", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 9))
    rows = [(k, (centres[k % 12] + rng.normal(size=9) * 0.08).tolist()) for k in range(600)] + [(900, [0.0] * 9), (901, None)] + [(1000 + k, centres[0].tolist()) for k in range(90)]
    queries = [("a", rows[0][1]), ("b", rows[5][1]), ("far", rng.normal(size=9).tolist()), ("zero", [0.0] * 9), ("same", centres[0].tolist()), ("none", None)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame(queries, "q string, w array<double>")
    index = clusters.Clusters(spark, str(tmp_path / "c")).build(table, "id", "v", size=50)
    found = sorted((r.query_id, r["rank"], r.id, round(r.score, 6) + 0.0) for r in index.search(asked, 6, "q", "w").collect())
    assert found == plain_cosine(rows, [x for x in queries if x[1]], 6)
    work = {r.query_id: (r.vectors, r.scored) for r in index.work(asked, 6, "q", "w").collect()}
    assert all(whole == 691 for whole, _ in work.values()) and work["a"][1] < 480 and work["b"][1] < 480


def test_remembered_words_are_bounded(monkeypatch):
    """However many words a task meets, it remembers a fixed number of them, and counts the same."""
    import pyarrow as pa

    from tracewell.operators import scoring

    words = [[f"w{i}", f"w{i + 1}", "ab", "w7"] for i in range(70_000)]
    held = pa.array(words)
    counter = scoring._TermCounter({"w7": 0, "ab": 1, "c2:ab": 2}, True)
    tf, length = counter(held)
    assert len(counter.seen) <= 1 << 16
    monkeypatch.setattr(scoring, "WORDS", 10**6)
    whole = scoring._TermCounter({"w7": 0, "ab": 1, "c2:ab": 2}, True)
    wanted, sizes = whole(held)
    assert len(whole.seen) > 70_000 and (tf == wanted).all() and (length == sizes).all()
    assert tf[7].tolist() == [2.0, 1.0, 1.0] and tf[0].tolist() == [1.0, 1.0, 1.0]
