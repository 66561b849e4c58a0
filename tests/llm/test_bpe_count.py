import random

import public_tokenizers
from helpers import docs, odd_rows
from tokenizers import Tokenizer

from tracewell.llm import bpe_count as b

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library():
    rnd, counter, library = random.Random(1), b.load(PATH), Tokenizer.from_file(PATH)
    parts = ["the", " the", "  ", "\n", "\t", "é", "日本", "😀", "'s", "'LL", "123", "!!", "<|endoftext|>", "<|endof", "aaaa", " ", " ", "_", "x" * 30, "ÀÈ", "²", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_merging_without_memo_and_long_pre_tokens(monkeypatch):
    rnd, library = random.Random(2), Tokenizer.from_file(PATH)
    counter = b.PairCounter([], [])
    assert counter.count("abc d") == 5
    counter = b.load(PATH)
    word = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    assert counter.merged(word.encode()) == len(library.encode(word, add_special_tokens=False).ids)
    monkeypatch.setattr(b, "WHOLE_CHARS", 10)
    assert counter.count("some words, and more words") == len(library.encode("some words, and more words").ids)


def test_table_and_odd_rows(spark):
    library = Tokenizer.from_file(PATH)
    frame = odd_rows(spark).withColumn("n_tokens", b.F.lit(-1))
    rows = b.count_tokens(frame, PATH, limit=5).collect()
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    assert len(rows) == 8
    for r in rows:
        want = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), want, want > 5)
    assert b.count_tokens(docs(spark, []), PATH).count() == 0
