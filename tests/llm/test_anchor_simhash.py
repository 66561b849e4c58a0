import random

import numpy as np
import xxhash
from helpers import docs, lower, odd_rows, words

from tracewell.llm import anchor_simhash as a
from tracewell.llm.graph import components


def plain_print(text):
    own = words(lower(text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[k:k + 3]) for k in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k, own in enumerate(ids):
        groups.setdefault(find(k), []).append(own)
    return [min(groups[find(k)]) for k in range(len(ids))]


def test_linked_prints_share_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1500).astype(np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    held = []
    for own in (x, y):
        anchors = [set() for _ in own]
        for anchor, owner in a.anchors_of(own):
            for p, q in zip(anchor.tolist(), owner.tolist()):
                anchors[q].add(p)
        held.append(anchors)
    assert all(p & q for p, q in zip(*held)) and max(map(len, held[0])) <= 34


def test_every_word_is_covered_within_one():
    halves = np.random.default_rng(2).integers(0, 2**32, 5000).astype(np.uint64)
    anchor, owner = next(a.anchors_of(halves))
    near = np.bitwise_count(anchor.astype(np.uint64) ^ halves[owner])
    least = np.full(len(halves), 99)
    np.minimum.at(least, owner, near)
    assert near.max() == 2 and least.max() <= 1


def test_report_equals_a_plain_comparison(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(["aa", "Bb", "cc", "dd", "é", "日本"]) + str(rnd.randint(0, 99)) for _ in range(rnd.choice([1, 2, 5, 60, 200]))) for _ in range(40)]
    texts = list(base)
    for text in base:
        own = text.split(" ")
        for _ in range(rnd.randint(0, 4)):
            own = list(own)
            own[rnd.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    texts += [base[0]] * 30 + ["", None, " \n"]
    rnd.shuffle(texts)
    rows = sorted(a.report(docs(spark, texts)).collect())
    prints = [plain_print(t) for t in texts]
    assert [int(r.fingerprint, 16) for r in rows] == prints and all(len(r.fingerprint) == 16 for r in rows)
    assert [r.component_id for r in rows] == plain_components(prints, range(len(texts)))


def test_dense_groups_stay_small_and_whole():
    rng = np.random.default_rng(4)
    own = np.uint64(rng.integers(0, 2**63)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    own = np.unique(own).view(np.int64)
    left, right = a.links_in(np.zeros(len(own), np.int64), own)
    assert len(left) == len(own) - 1 and (np.bitwise_count(own.view(np.uint64)[0] ^ own.view(np.uint64)) <= 4).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(200)] + [(7, 7), (2, 1)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 101)} | {k: 500 for k in range(501, 700)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_and_odd_rows(spark):
    frame = odd_rows(spark)
    found = a.near_duplicates(frame).collect()
    assert len(found) == 8 and {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    kept = a.one_of_each(frame)
    assert set(kept.columns) == set(frame.columns)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 4, 5, 6], key=str)
    assert a.report(docs(spark, [])).count() == 0


def test_one_of_each_keeps_one_row_of_every_group_whatever_the_ids(spark):
    story, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in ("river", "stone", "cloud"))
    rows = [(1, story), (2, story), (2, other), (3, other), (4, third), (4, story + " end of another text altogether " + third),
            (None, "no id here at all"), (None, "no id here at all"), (5, "the same"), (5, "the same")]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in a.one_of_each(frame).collect()), key=str)
    assert kept == sorted([(1, story), (2, other), rows[4], rows[5], rows[6], rows[8]], key=str)
