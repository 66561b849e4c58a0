import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import docs, odd_rows

from tracewell.llm import maxplus_pieces as m

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "e", "t", "h", " ", "  ", "\n", "é", "ñ", "日", "本", "😀", "▁", " the", "ing", "    ", "0", "1", "ab", "aa", ",", ".", "_", "'s"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(coded):
    return np.frombuffer(coded, "<i4").tolist()


def test_ids_equal_the_library(library):
    rnd, pieces = random.Random(1), m.load(PATH)
    for _ in range(1500):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60)))
        assert ids(pieces.encode(text)) == library.encode(text), text
        assert pieces.decode(pieces.encode(text)) == text.replace("▁", " ")


def test_chunks_give_the_same_ids():
    rnd, pieces = random.Random(2), m.load(PATH)
    for k in range(400):
        text = pieces.normal("".join(rnd.choice(ALPHABET if k % 3 else "abeth") for _ in range(rnd.randint(100, 400))))
        size = rnd.choice([40, 64, 100, 200])
        edges = [*range(0, max(1, len(text) - size // 2), size), len(text)]
        parts = []
        for a, b in zip(edges, edges[1:]):
            low = max(0, a - pieces.longest)
            parts.append((text[low:b + pieces.longest], a - low, b - low))
        matrices = [pieces.transfer(*x) for x in parts]
        states, weight = m.boundary_states(matrices)
        coded = b"".join(pieces.traced(*x, states[j], states[j + 1])[0] for j, x in enumerate(parts))
        last = pieces.forward(text, 0, m.START, len(text))
        assert coded == pieces.coded(pieces.back(last, len(text)))
        assert -weight == len(pieces.back(last, len(text)))


def test_products_are_associative():
    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random(s) < 0.3, m.NEVER, -rng.integers(1, 9, s)) for s in ((3, 4), (4, 2), (2, 5)))
    assert np.array_equal(m.times(m.times(a, b), c), m.times(a, m.times(b, c)))


def test_tables_with_giant_texts(spark, library):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(ALPHABET[:9]) for _ in range(n)) for n in (10, 700, 3000, 999, 1001)] + ["", None, "x" * 2500]
    frame = docs(spark, texts).union(docs(spark, texts[2:3], first=2))
    rows = m.encode(frame, PATH, chunk=300).collect()
    assert len(rows) == 9
    for row in rows:
        want = library.encode(texts[row.doc_id] or "")
        assert row.pieces.ids == want and row.pieces.n_pieces == len(want) and row.pieces.round_trip
        assert row.pieces.ids_sha256 == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
    back = m.encode(frame, PATH).select("text", m.decoded(m.F.col("pieces.ids"), PATH).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


def test_odd_rows(spark):
    assert m.report(odd_rows(spark), PATH).count() == 8
    assert m.report(docs(spark, []), PATH).count() == 0
    clash = docs(spark, ["one two"]).withColumn("pieces", m.F.lit(1)).withColumn("row", m.F.lit(2))
    assert set(m.encode(clash, PATH).columns) == {*clash.columns}
