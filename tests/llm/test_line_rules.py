import random

from helpers import docs, odd_rows, words

from tracewell.llm import line_rules as r

GOOD = "The committee met on Tuesday to discuss the plan for the river bank.\nIt was decided to wait for the spring, when the water is low.\n"


def brute(text):
    text = text or ""
    own = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(own[k:k + 5]) for k in range(len(own) - 4)]
    marked = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), len(own) < 10 or 100 * len(marked) > 20 * len(own)


def test_counts_equal_a_plain_count(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "é ", "b ", "\n", " ", "#", "日本 ", "x y z u v ", "\x0b", "\r\n"]) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    for row in r.judge(docs(spark, texts)).collect():
        want = brute(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == want
        assert not (row.kept and row.base_failed)


def test_rules_per_line():
    def rule(line):
        return r.failing(line.encode(), r.LineRules())

    assert rule("The committee met on Tuesday.") is None
    assert rule("Home | News | Sport | Contact | About us.") == "navigation"
    assert rule("BUY NOW AND SAVE A LOT OF MONEY!!") == "shouting"
    assert rule("Read### this$$$ now%%% and&&& then***.") == "symbols"
    assert rule("© 2020 The Company. All rights reserved.") == "boilerplate"
    assert rule("Related stories of today") == "unended"


def test_lines_go_first_and_then_the_document(spark):
    mixed = GOOD * 1 + "Home | News | Sport | Contact | About\nClick here to subscribe now!"
    junk = "Home | News | Sport | Contact | About\n" * 1 + "Menu | Login | Help | More | Less\nA short good line."
    texts = [GOOD, mixed, junk, None]
    frame = docs(spark, texts)
    assert [x.kept for x in r.judge(frame).orderBy("doc_id").collect()] == [True, True, False, False]
    cleaned = [x[0] for x in frame.select(r.cleaned(frame.text)).collect()]
    assert cleaned[0] == GOOD and cleaned[1] == GOOD.rstrip("\n") and cleaned[2:] == [None, None]


def test_odd_rows(spark):
    rows = r.judge(odd_rows(spark)).collect()
    assert len(rows) == 8 and all(x.base_failed for x in rows if x.doc_id in (1, 2, 3))
    assert r.judge(docs(spark, [])).count() == 0
