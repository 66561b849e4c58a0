import random
import zlib

import numpy as np
from helpers import docs, odd_rows

from tracewell.llm import lang_bits as b

STOCK = {"aa": "the of and that with from this have which were their", "bb": "der die und nicht mit auch einer wurde über für können",
         "cc": "le la les des une dans pour qui été avec être", "dd": "日本 の は です を した 言語 文章"}


def sample(n=200, seed=1):
    rnd = random.Random(seed)
    langs = [rnd.choice(list(STOCK)) for _ in range(n)]
    return [" ".join(rnd.choice(STOCK[x].split()) for _ in range(rnd.randint(3, 40))) for x in langs], langs


def test_held_out_accuracy(spark):
    texts, langs = sample()
    frame = docs(spark, texts, langs)
    model = b.fit(frame.where(b.F.crc32(b.F.col("doc_id").cast("string").cast("binary")) % 4 != 2), least=2)
    rows = frame.select("doc_id", b.predict(frame.text, model).alias("p")).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([r.p.lang == langs[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.p.score <= 1 for r in rows)


def test_filter_holds_every_gram_it_took(spark):
    texts, langs = sample(60, 2)
    model = b.fit(docs(spark, texts, langs), least=1, share=0.0)
    n, hits = b.tallies(model, [t.encode() for t in texts])
    for k, lang in enumerate(langs):
        assert hits[k, model.languages.index(lang)] == n[k]
    plain = [len([1 for w in (" " + " ".join(t.lower().split()) + " ").encode().split(b" ") for _ in range(max(0, len(w) - 1))]) for t in texts]
    assert [int(x) for x in n] == plain


def test_long_texts_in_parts_count_the_same(monkeypatch, spark):
    texts, langs = sample(40, 3)
    model = b.fit(docs(spark, texts, langs), least=1)
    whole = b.tallies(model, [t.encode() for t in texts])
    monkeypatch.setattr(b, "PIECE", 37)
    parts = b.tallies(model, [t.encode() for t in texts])
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_more_languages_than_one_byte(spark):
    texts = [" ".join(f"{chr(97 + k)}{chr(97 + k)}{chr(97 + j)}{chr(97 + k)}" for j in range(8)) for k in range(20)]
    frame = docs(spark, texts * 3, [f"l{k:02d}" for k in range(20)] * 3)
    model = b.fit(frame)
    assert len(model.languages) == 20 and model.bits.dtype == np.uint32
    rows = frame.select("lang", b.predict(frame.text, model).alias("p")).collect()
    assert all(r.lang == r.p.lang for r in rows)


def test_close_languages_stay_in_the_pipeline(spark):
    import corpus_pipeline

    rnd = random.Random(6)
    words = "kuća more grad čovjek vrijeme dobar dan velika rijeka stara knjiga putuje kroz planinu".split()
    texts = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(80)]
    frame = docs(spark, [*texts, "qwx zzkp vvrt jjkl wqpf bbnm xxcz"], [("bs", "hr", "sh", "sr")[k % 4] for k in range(80)] + [None])
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, frame, "").collect()}
    assert kept == set(range(80))


def test_more_than_64_languages(spark):
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}{chr(97 + k % 26)}" for j in range(8)) for k in range(130)]
    frame = docs(spark, texts * 3, [f"l{k:03d}" for k in range(130)] * 3)
    model = b.fit(frame)
    assert len(model.languages) == 130 and model.bits.shape[0] == 3
    rows = frame.select("lang", b.predict(frame.text, model).alias("p")).collect()
    assert all(r.lang == r.p.lang for r in rows)


def test_odd_rows_and_empty_tables(spark):
    texts, langs = sample(30, 4)
    model = b.fit(docs(spark, texts, langs), least=1)
    frame = odd_rows(spark)
    rows = frame.select("doc_id", "text", b.predict(frame.text, model).alias("p")).collect()
    assert all((r.p.lang == "und") == (not r.text or not any(map(str.isalpha, r.text))) for r in rows)
    empty = b.fit(docs(spark, []))
    assert empty.languages == [] and frame.select(b.predict(frame.text, empty).alias("p")).where("p.lang != 'und'").count() == 0
