import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import docs, lower, odd_rows, words

from tracewell.llm import attention_lm as a

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    held = a.classes_of(rng.integers(0, 100, 5000))
    w = {k: v.astype(np.float64) for k, v in a.start_weights(held.prior).items()}
    x, y, m = rng.integers(0, a.INPUTS, (4, 32)), rng.integers(0, a.CLASSES, (4, 16)), np.ones((4, 16))
    m[0, 9:] = 0
    opening = np.array([True, False, False, True])
    _, g = a.loss_and_gradient(w, x, y, m, opening)
    for name in w:
        place = (x[1, 20], 3) if name == "E" else tuple(rng.integers(0, n) for n in w[name].shape)
        ends = []
        for step in (1e-4, -2e-4):
            w[name][place] += step
            ends.append(a.loss_and_gradient(w, x, y, m, opening)[0])
        w[name][place] += 1e-4
        assert math.isclose((ends[0] - ends[1]) / 2e-4, g[name][place], rel_tol=1e-3, abs_tol=1e-8), name


def test_windows_that_share_a_half_have_the_same_gradient():
    rng = np.random.default_rng(6)
    held = a.classes_of(rng.integers(0, 100, 5000))
    w = {k: v.astype(np.float64) for k, v in a.start_weights(held.prior).items()}
    flat, chosen, opening = a.windows_of([rng.integers(0, 40, n) for n in (50, 3, 16, 90)], a.INPUTS)
    halves, follows = flat.reshape(-1, 16), np.diff(chosen) == 1
    x, y = np.concatenate([halves[chosen - 1], halves[chosen]], axis=1), rng.integers(0, a.CLASSES, (len(chosen), 16))
    assert follows.any() and not follows.all()
    told, g = a.loss_and_gradient(w, x, y, np.ones(y.shape), opening, follows=follows)
    plain, want = a.loss_and_gradient(w, x, y, np.ones(y.shape), opening)
    assert told == plain
    for name in w:
        assert np.allclose(g[name], want[name], rtol=1e-9, atol=1e-12), name


@pytest.mark.parametrize("size", [0, 5, 64, 200, 7000])
def test_batches_are_sorted_at_once_as_one_by_one(size):
    target = np.random.default_rng(8).integers(0, a.CLASSES, size)
    got = a.by_batch_and_group(target, 64)
    want = [a.by_group(target[k:k + 64]) for k in range(0, size, 64)]
    assert [(o.tolist(), p) for o, p in got] == [(o.tolist(), p) for o, p in want]


def test_ids_of_all_words_are_counted(spark):
    words = {"the": 5, "été": 2, "x'sy": 3, "a,b": 1, "odd\u00a0": 4, "\u2003": 2, "日本": 7, a.END: 9}
    want = np.zeros(a.n_ids(PATH), np.int64)
    for word, n in words.items():
        for k in [len(want) - 1] if word == a.END else a.ids_of([word.encode()], PATH)[:-1]:
            want[k] += n
    for own in (words, {a.END: 2}, {"the": 1}):
        got = a.id_counts(spark.createDataFrame(list(own.items()), "word string, n long").coalesce(1), PATH)
        assert (got == want).all() if own is words else got.sum() == sum(own.values())


def test_weights_that_overflow_an_exponential_still_sum_to_one():
    rng = np.random.default_rng(7)
    held = a.classes_of(rng.integers(0, 50, 800), inputs=256)
    w = {k: v * np.float32(12) for k, v in a.start_weights(held.prior, 256).items()}
    begin = rng.integers(0, 800, 20)
    parts = [np.append(begin, k) for k in range(800)]
    last = [c[-1] + held.within[p[-1]] for c, p in zip(a.Scorer(w, held).class_scores(parts), parts)]
    assert abs(sum(10.0 ** x for x in last) - 1) < 1e-3


ODD_TEXTS = ["The  the\tTHE\n", None, "", " ", "a", "b a", "\x0b\x0cé É\u00a0x \u2003 \x1fz\r", "end ", " begin", "日本 日本", "end"]


def test_words_are_split_as_by_python():
    column = pa.array(ODD_TEXTS)
    for part in (column, column[3:9], column[:0], column[1:2], pa.concat_arrays([column, column]).cast(pa.large_string())[4:17]):
        distinct, codes, begin = a.split_words(part)
        spelled = distinct.to_pylist()
        assert len(begin) == len(part) + 1 and len(spelled) == len(set(spelled))
        for k, text in enumerate(part.to_pylist()):
            assert [spelled[c] for c in codes[begin[k]:begin[k + 1]]] == a.words_in(text.encode() if text else None)


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_word_counts_of_a_task_equal_a_plain_count(monkeypatch, most):
    monkeypatch.setattr(a, "HELD_WORDS", most)
    batches = [pa.record_batch({"text": pa.array(ODD_TEXTS[k:k + 4])}) for k in range(0, 12, 4)]
    got, want = Counter(), Counter()
    for batch in a._counted(iter(batches)):
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got[word] += n
    for text in ODD_TEXTS:
        want.update([w.decode() for w in a.words_in(text.encode() if text else None)] + [a.END])
    assert got == want


def test_a_word_is_looked_up_once_a_batch():
    table = a.WordIds([b"the", b"of"], [4, 3], PATH)
    distinct, codes, begin = a.split_words(pa.array(["the of the", None, "of rare the rare", "rare"] * 50))
    number = table.numbers(distinct.to_pylist())
    assert len(number) == 3
    flat, ends = table.lines(distinct.to_pylist(), number, codes, begin)
    want = [a.ids_of(t.split(), PATH).tolist() for t in (b"the of the", b"", b"of rare the rare", b"rare")] * 50
    assert [p.tolist() for p in np.split(flat, ends[:-1])] == want


def test_each_id_is_scored_once_with_its_window():
    rng = np.random.default_rng(1)
    held = a.classes_of(rng.integers(0, 100, 3000))
    w = a.start_weights(held.prior)
    parts = [rng.integers(0, 3000, n) for n in (1, 15, 16, 17, 33, 100)]
    for part, got in zip(parts, a.Scorer(w, held).class_scores(parts)):
        line = np.concatenate([np.full(16, a.INPUTS), held.inputs[part], np.zeros(16, int)])
        assert len(got) == len(part)
        for i in range(len(part)):
            block, j = divmod(i, 16)
            x = w["E"][line[16 * block:16 * block + 32]] + w["P"]
            s = x[15 + j] @ w["Q"] @ (x[:16 + j] @ w["K"]).T / 4
            if block == 0:
                s[:15] = -1e9
            p = np.exp(s - s.max())
            hidden = x[15 + j] + p / p.sum() @ (x[:16 + j] @ w["V"]) @ w["O"]
            group, place = divmod(held.classes[part[i]], a.GROUP_CLASSES)
            want = 0.0
            for z, right in ((hidden @ w["G"] + w["g"], group), (hidden @ w["U"][group] + w["b"][group], place)):
                want += (z[right] - z.max() - np.log(np.exp(z - z.max()).sum())) / np.log(10)
            assert abs(want - got[i]) < 1e-4


def test_probabilities_of_all_next_ids_sum_to_one():
    rng = np.random.default_rng(2)
    held = a.classes_of(rng.integers(0, 50, 800), inputs=256)
    scorer = a.Scorer(a.start_weights(held.prior, 256), held)
    begin = rng.integers(0, 800, 20)
    parts = [np.append(begin, k) for k in range(800)]
    last = [c[-1] + held.within[p[-1]] for c, p in zip(scorer.class_scores(parts), parts)]
    assert abs(sum(10.0 ** x for x in last) - 1) < 1e-4


def test_word_table_gives_the_ids_of_the_whole_text():
    stock = [w.encode() for w in ["the", "of", "été", "a,b", "日本", "x'sy", "\u00a0odd", "odd\u00a0", "don't", "\u2003", "😀"]]
    table = a.WordIds(stock[:4], [4, 3, 2, 1], PATH)
    rng = np.random.default_rng(5)
    texts = [[stock[k] for k in rng.integers(0, len(stock), int(n))] for n in [0, 1, 5, 40, 0, 200]]
    for got, words_ in zip(table.sequences([(t, table.numbers(t)) for t in texts]), texts):
        assert got.tolist() == a.ids_of(words_, PATH).tolist()


@pytest.mark.parametrize("frequent", [0, 8, 10_000])
def test_base_scores_equal_a_plain_count(spark, frequent):
    rng = np.random.default_rng(3)
    stock = ["the", "The", "of", "été", "naïve", "x1", "日本", "a,b", *[f"w{k}" for k in range(40)]]
    texts = [" ".join(rng.choice(stock, int(n))) for n in rng.integers(0, 60, 60)] + [None, "", "never-seen-elsewhere"]
    got = {r.doc_id: r for r in a.score(docs(spark, texts), PATH, settings=a.Settings(frequent=frequent)).collect()}
    count = Counter()
    for k, text in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            count.update([*words(lower(text or "")), None])
    total, distinct = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        own = [*words(lower(text or "")), None]
        row = got[k]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(own), sum(count[w] > 0 for w in own), total)
        assert row.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert math.isclose(row.base_score, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
        assert row.score < 0


def test_training_beats_the_class_rates(spark):
    rng = np.random.default_rng(4)
    cycle = ["red", "green", "blue", "stone", "river"]
    texts = [" ".join(cycle[(s + k) % 5] for k in range(300)) for s in rng.integers(0, 5, 80)]
    frame = docs(spark, texts)
    counts = a.word_counts(frame.select("text"))
    held = a.classes_of(a.id_counts(counts, PATH))
    weights = a.fit(frame.select("text"), held, PATH, a.Settings(share=1))
    ids = [a.ids_of(t.encode().split(), PATH) for t in texts[:5]]
    fitted, start = (sum(a.Scorer(w, held).scores(ids)) for w in (weights, a.start_weights(held.prior)))
    assert fitted > 0.5 * start


def test_long_texts_without_white_space_are_learned_from(spark):
    assert a.Settings().share == 1
    frame = docs(spark, ["".join("日月水火"[(s + k) % 4] for k in range(6000)) for s in range(4)])
    held = a.classes_of(a.id_counts(a.word_counts(frame.select("text")), PATH))
    ids = [a.ids_of(["水火日月".encode() * 50], PATH)]
    start = sum(a.Scorer(a.start_weights(held.prior), held).class_scores(ids)[0])
    for share in (1, 8):
        weights = a.fit(frame.select("text"), held, PATH, a.Settings(share=share))
        assert sum(a.Scorer(weights, held).class_scores(ids)[0]) > 0.5 * start, share
    text = frame.first().text.encode()
    whole = a.ids_of([text], PATH)
    assert np.array_equal(np.concatenate(a.runs_of(text, PATH, 1)), whole)


def test_odd_rows_and_empty_tables(spark):
    rows = a.score(odd_rows(spark), PATH).collect()
    assert len(rows) == 8 and sum(r.doc_id == 4 for r in rows) == 2 and not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert a.score(docs(spark, []), PATH).count() == 0
