import random
import re
import zlib
from collections import Counter
from itertools import combinations

from helpers import docs, lower, odd_rows

from tracewell.llm import pivotal_grams as p


def plain_words(rows, modulus=97):
    found = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if own is None else own}:{word}".encode())
            if h % modulus == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        if own:
            top = min(own, key=lambda v: (-counts[v], v))
            if counts[top] >= 2 * counts[w]:
                form[w] = top

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def key(row):
    return tuple(row)


def some_texts(seed, size=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abnot") for _ in range(r.randint(4, 9))) for _ in range(40)] + ["banana", "ananas", "école", "Größe", "ÀÀÀÀÀ", "aaaaaa", "aaaaa", "aaaaaaa"]

    def bent(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w, w[:k] + w[k + 1:], w[:k] + r.choice("abnoté") + w[k:], w[:k] + r.choice("abnotß") + w[k + 1:]])

    return [" ".join(bent(r.choice(base)) + r.choice(["", ",", "1", "\n", "_x"]) for _ in range(r.randint(0, 80))) for _ in range(size)]


def test_variants_equal_plain_comparison(spark):
    for seed in range(3):
        texts = some_texts(seed)
        found = sorted(map(key, p.report(docs(spark, texts)).collect()), key=lambda x: x[0])
        assert found == plain_variants(plain_words(enumerate(texts)))
        assert any(x[1] for x in found)


def test_deletions_follow_the_checksum(spark):
    texts = some_texts(9, 40)
    found = {r.word: r.n for r in p.vocabulary(docs(spark, texts), modulus=3).collect()}
    assert found == plain_words(enumerate(texts), 3)


def test_near_words_share_a_pivot():
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(5, 8))) for _ in range(900)})
    grams = Counter(w[k:k + 2] for w in words for k in range(len(w) - 1))
    order = {g: k for k, g in enumerate(sorted(grams, key=lambda g: (grams[g], g)))}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            shared = False
            for x, y in ((a, b), (b, a)):
                for gram, at in p.pivots_of(p.prefix_of(x, order)):
                    shared |= any(gram == other and at - place in (0, len(x) - len(y)) for other, place in p.prefix_of(y, order))
            assert shared, (a, b)


def test_pivots_are_the_rarest_disjoint_pair():
    r = random.Random(5)
    for _ in range(500):
        word = "".join(r.choice("abc") for _ in range(r.randint(5, 12)))
        order = {x + y: k for k, (x, y) in enumerate(r.sample([(x, y) for x in "abc" for y in "abc"], 9))}
        prefix = p.prefix_of(word, order)
        found = p.pivots_of(prefix)
        assert abs(found[0][1] - found[1][1]) >= 2
        assert sum(g for g, _ in found) == min(x[0] + y[0] for x, y in combinations(prefix, 2) if abs(x[1] - y[1]) >= 2)


def test_odd_rows(spark):
    rows = odd_rows(spark)
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    clash = rows.withColumnRenamed("lang", "word").withColumnRenamed("source", "n").withColumnRenamed("n_chars", "own")
    assert sorted(map(key, p.report(clash).collect())) == plain_variants(plain_words(texts))
    assert p.report(rows.limit(0)).count() == 0


def test_ties_repeated_rows_and_chains(spark):
    words = spark.createDataFrame([("aaaaa", 3), ("aaaab", 6), ("aaaac", 6), ("aaaad", 5), ("baaab", 12), ("bbaab", 23), ("ccccc", 4)], "word string, n long")
    found = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in p.variants(words).collect()}
    assert found["aaaaa"] == ("aaaab", "baaab", 3, 6) and found["aaaab"] == ("baaab", "baaab", 4, 12)
    assert found["aaaad"] == (None, "aaaad", 3, None) and found["baaab"] == (None, "baaab", 2, None) and found["ccccc"] == (None, "ccccc", 0, None)
    texts = ["hello world hello"] * 4
    assert {r.word: r.n for r in p.vocabulary(docs(spark, texts)).collect()} == plain_words(enumerate(texts))


def test_long_texts_are_counted_whole(spark):
    text = "lengthy words " * 90_000
    assert {r.word: r.n for r in p.vocabulary(docs(spark, [text])).collect()} == plain_words([(0, text)])


def test_edits_are_told_in_numpy_as_one_by_one():
    import numpy as np
    r = random.Random(8)
    words = ["".join(r.choice("abß") for _ in range(r.randint(1, 7))) for _ in range(60)] + ["a" * 48, "a" * 47, "a" * 47 + "b", "a" * 49, "b" + "a" * 48, "a" * 60 + "b", "a" * 61]
    x, y = (z.ravel() for z in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    found = p._near(words, np.array(list(map(len, words))), x, y)
    assert found.tolist() == [one_edit(words[i], words[j]) for i, j in zip(x, y)] == [p.one_edit(words[i], words[j]) for i, j in zip(x, y)]


def test_small_blocks_of_rows_and_meetings(spark, monkeypatch):
    monkeypatch.setattr(p, "ROWS", 7)
    monkeypatch.setattr(p, "MEETINGS", 3)
    texts = some_texts(12)
    found = sorted(map(key, p.report(docs(spark, texts)).collect()), key=lambda x: x[0])
    assert found == plain_variants(plain_words(enumerate(texts)))
