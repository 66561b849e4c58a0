import hashlib
import random
import re

import numpy as np
import pytest
from helpers import docs, lower, odd_rows

from tracewell.llm import fm_decontaminate as d
from tracewell.llm.fm_index import FmIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    own = WORD.findall(lower(text or ""))
    hit, met = set(), set()
    for name, item in items:
        words = WORD.findall(lower(item or ""))
        for k in range(max(1, len(words) - 12) if words else 0):
            window = words[k:k + 13]
            for at in range(len(own) - len(window) + 1):
                if own[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    met.add(str(name))
    return len(own), len(hit), sorted(met)


def test_index_finds_all_places():
    rng = np.random.default_rng(0)
    for _ in range(40):
        text = rng.integers(1, 4, rng.integers(1, 200))
        if rng.random() < 0.5:
            text = np.tile(text, 3)
        index = FmIndex(text, 2)
        patterns = rng.integers(1, 4, (20, 5))
        for row in range(20):
            patterns[row, :rng.integers(0, 5)] = -1
        low, high = index.ranges(patterns)
        for pattern, a, b in zip(patterns, low, high):
            pattern = pattern[pattern >= 0]
            want = [k for k in range(len(text) - len(pattern) + 1) if (text[k:k + len(pattern)] == pattern).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def sample(rnd):
    stock = ["alpha", "Beta", "gamma", "été", "x1", "delta", "9", "omega"]
    items = [(k, " ".join(rnd.choice(stock) for _ in range(rnd.choice([3, 12, 13, 14, 30])))) for k in range(12)] + [(50, ""), (51, "..."), (None, "one two three"), (7, None)]
    texts = []
    for _ in range(120):
        parts = [" ".join(rnd.choice([*stock, "other", "words"]) for _ in range(rnd.randint(0, 40)))]
        if rnd.random() < 0.5:
            parts.insert(rnd.randint(0, 1), (rnd.choice(items)[1] or "").upper().replace(" ", ", "))
        texts.append(" ".join(parts))
    return items, [*texts, None, "", "one-two.three"]


@pytest.mark.parametrize("shard", [60, 1000, d.SHARD])
def test_hits_equal_a_plain_search(shard):
    items, texts = sample(random.Random(3))
    held = d.phrases([("" if n is None else str(n), t.encode()) for n, t in items if t is not None])
    for text, got in zip(texts, d.mark([t if t is None else t.encode() for t in texts], held, shard)):
        n, hits, met = brute(text, [("" if name is None else name, t) for name, t in items])
        assert (got["n_words"], sum(s["end"] - s["start"] for s in got["spans"]), got["items"]) == (n, hits, met)


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 200])
def test_table_in_one_and_in_several_blocks(spark, block_bytes, monkeypatch):
    items, texts = sample(random.Random(4))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d.blocks_of, "__defaults__", ("item_id", "text", block_bytes))
    for row in d.report(docs(spark, texts), benchmark).collect():
        n, hits, met = brute(texts[row.doc_id], [("" if name is None else name, t) for name, t in items])
        assert (row.n_words, row.n_hit, row.n_items) == (n, hits, len(met))
        assert row.items_sha256 == hashlib.sha256(",".join(met).encode()).hexdigest()
        assert row.contaminated == (hits > 0 and 20 * hits >= n)


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = d.report(odd_rows(spark), none).collect()
    assert len(rows) == 8 and not any(r.contaminated for r in rows)
    assert d.report(docs(spark, []), none).count() == 0
