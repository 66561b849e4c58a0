from pyspark.sql import functions as F

from tracewell.functions import identity, money, patterns, spans, text
from tracewell.functions.packing import pack


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def values(spark, data, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, x string").orderBy("i").select(column).collect()]


def test_tokens_and_terms(spark):
    x = F.col("x")
    row = one(spark, "매출ㆍ원가 1,250.5 ABC a", text.lexical_tokens(x).alias("t"))
    assert row["t"] == ["매출", "원가", "1,250.5", "abc", "a", "c2:매출", "c2:원가", "c2:ab", "c2:bc"]
    row = one(spark, "매출은 매출에서 현재 은행으로 자료 가로", text.terms(x).alias("t"))
    assert row["t"] == ["매출", "은행", "가로"]
    assert one(spark, "a-b, c!", text.terms(x).alias("t"))["t"] == []


def test_routing(spark):
    got = values(spark, ["안녕", "시장은?", "이 회사 첨부", "심사의견 왜 그렇게"], text.chat_intent(F.col("x")))
    assert got == ["GENERAL", "GENERAL", "CASE_QA", "OPINION_QA"]


def test_completeness_and_tail(spark):
    x = F.col("x")
    assert values(spark, ["양호함", "끝났다.", "증가하며", "자료,"], text.looks_complete(x)) == [True, True, False, False]
    cite = "[CR_" + "a" * 20 + "]"
    got = values(spark, [f"첫 문장. {cite} 미완성", "완결됨\n중간에", "아무것도", "좋다!"], text.rollback_tail(x))
    assert got == [f"첫 문장. {cite}", "완결됨", "아무것도", "좋다!"]


def test_claims_keep_decimals(spark):
    said = "비율은 58.3%이다. 기준일 2026.03.23 확인.\n다음"
    row = one(spark, said, text.claim_sentences(F.col("x")).alias("a"), spans.claim_spans("x").alias("s"))
    assert row["a"] == ["비율은 58.3%이다.", " 기준일 2026.03.23 확인.", "다음"]
    assert [s["text"] for s in row["s"]] == row["a"] and row["s"][2]["start"] == said.index("다음")


def test_numeric_tokens(spark):
    data = ["2024년 3월 매출 1,250.50백만원, 증가율 12.30% 3 B12=99 -5 2023.01.02 기준 CR_" + "a" * 20, "2025년 말", "12,2024.01.02", "1.2.3%", "+2024-1-2 7",
            "A1:B22 2024.13.01 x5 5x 12%a 3 배", "2023년 5월 말 5월", None, "1999 년 12 월 31 일 + 2,000     원"]
    got = [[tuple(t) for t in v] for v in values(spark, data, spans.numeric_tokens("x"))]
    assert [t[1:4] for t in got[0]] == [
        ("2023-01-02", "date", None), ("2024-03", "period", "월"), ("12.3", "percent", "%"), ("1250.5", "number", "백만원"), ("99", "number", None), ("-5", "number", None)]
    assert got[0][3][4] == ["2023", "2024"] and got[0][0][4] == ["2023"]
    assert got[1][0][1:4] == ("2025", "year", "년")
    assert got[2] == [("2024.01.02", "2024-01-02", "date", None, ["2024"])]
    assert [t[:3] for t in got[3]] == [("2.3%", "2.3", "percent")]
    assert [t[1:3] for t in got[4]] == [("2024-01-02", "date")]
    assert [t[:4] for t in got[5]] == [("2024.13", "2024.13", "number", None), ("01", "1", "number", None), ("12", "12", "number", None), ("3", "3", "number", "배")]
    assert [t[1:4] for t in got[6]] == [("2023-05", "period", "월"), ("5", "number", "월")] and got[7] == []
    assert [t[:4] for t in got[8]] == [("1999 년 12 월 31 일", "1999-12-31", "date", None), ("2,000", "2000", "number", "원")]


def test_canonical_number(spark):
    data = ["1,000", "-0.0", "+7.10", "100", "000.50", "-12.3400", "0", "1.0", "-0.00", "+007.10"]
    assert values(spark, data, text.canonical_number(F.col("x"))) == ["1000", "0", "7.1", "100", "0.5", "-12.34", "0", "1", "0", "7.1"]


def test_money(spark):
    data = [("164134131441", "원", "164,134.1"), ("(1250)", "천원", "-1.3"), ("2.25", "백만원", "2.3"), ("3", "억원", "300"), ("x", "원", "x"), ("5", "EA", "5")]
    df = spark.createDataFrame(data, "v string, u string, want string")
    for r in df.select("want", money.normalize_money(F.col("v"), F.col("u")).alias("m")).collect():
        assert r["m"]["text"] == r["want"]
    assert one(spark, "총 1,234,567천원, (500)만원, 7천원과", money.rewrite_amounts("x").alias("t"))["t"] == "총 1,234.6백만원, -5백만원, 7천원과"


def test_identity(spark):
    import hashlib

    want = "GCH_" + hashlib.sha256("t\x1fc\x1fd\x1fl\x1f".encode()).hexdigest()[:32]
    row = one(spark, " t ", identity.global_chunk_id(F.col("x"), "c", "d", "l", 0).alias("a"), identity.global_chunk_id(F.col("x"), "c", "d", "l", 1).alias("b"))
    assert row["a"] == want and row["b"] != want


def test_expand_and_style(spark):
    row = one(spark, "단기차입금 소송", text.expand_query(F.col("x")).alias("q"))
    assert row["q"].startswith("단기차입금 소송\n검색개념: 차입금, 유동부채, 금융부채, 법적소송우발부채")
    row = one(spark, "㈜한빛 2024.03.05 매출 77%와 2023년 10", text.mask_style(F.col("x"), ["매출"]).alias("s"))
    assert row["s"] == "특정기업 특정일자 특정대상 수치와 특정기간 수치"
    assert one(spark, "a\n[VALUE] b\nc", text.strip_placeholders(F.col("x")).alias("s"))["s"] == "a\nc"
    assert one(spark, "[value]", text.strip_placeholders(F.col("x")).alias("s"))["s"] == ""


def test_pack_equals_naive_fold():
    import random

    rng = random.Random(5)

    def naive(costs, limit, scopes, carry):
        out, current, scope = [], [], None
        for i, c in enumerate(costs):
            changed = bool(current) and scopes[i] != scope
            over = bool(current) and sum(costs[j] for j in current) + c > limit
            if changed or over:
                out.append((current[0], current[-1] + 1))
                kept = []
                if over and not changed and carry:
                    used = 0
                    for j in reversed(current):
                        if kept and used + costs[j] > carry:
                            break
                        kept.append(j)
                        used += costs[j]
                current = kept[::-1]
            if not current:
                scope = scopes[i]
            current.append(i)
        return out + ([(current[0], current[-1] + 1)] if current else [])

    for _ in range(300):
        n = rng.randint(0, 30)
        costs = [rng.randint(1, 60) for _ in range(n)]
        scopes = [rng.choice("ab") if rng.random() < 0.2 else "a" for _ in range(n)]
        carry = rng.choice([0, 10, 40])
        assert pack(costs, 80, scopes=scopes, carry_cost=carry) == naive(costs, 80, scopes, carry)
    assert pack([5, 5, 5, 5, 5], 11, carry_items=1) == [(0, 2), (1, 3), (2, 4), (3, 5)]


def test_scaffolding(spark):
    data = ["신용조사서 근거 요약\n\n| a | b |\n|---|---|\n2024.12\t1\t2\n의견이다.\n\n끝.", "그대로\n둔다", "앞\n| x | y |\n뒤", "근거요약\n| a |",
            "```markdown\n본문\n```"]
    got = values(spark, data, text.strip_scaffolding(F.col("x")))
    assert got == ["의견이다.\n\n끝.", "그대로\n둔다", "앞\n뒤", "근거요약\n| a |", "본문"]


def test_recurring_texts_are_scanned_once(monkeypatch):
    import pyarrow as pa

    from tracewell.functions import spans

    scanned = []
    real = spans._numbers_of
    monkeypatch.setattr(spans, "_numbers_of", lambda t: scanned.append(t) or real(t))
    texts = ["in 1995년 12%", None, "no figure", "2024.3.5 A1=20: 7배"] * 50 + ["once 30"]
    found = spans._numbers.func(pa.array(texts)).to_pylist()
    assert [[tuple(x.values()) for x in row] for row in found] == [real(t) for t in texts]
    assert len(scanned) == 5  # it was 201


def test_batches_are_worked_off_in_slices(monkeypatch):
    """Of a batch of 10,000 texts only a slice is held as Python text."""
    import tracemalloc

    import pyarrow as pa

    from tracewell.functions.vectors import hash_counts, hash_counts_of

    texts = pa.array([f"{i} " + "word " * 400 for i in range(4000)] + [None, ""])
    for run in (spans.char_split(1000, 100).func, hash_counts.func):
        tracemalloc.start()
        found = run(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == len(texts) and peak < 4_000_000  # it was more than the texts, 8 MB
    assert found[7].as_py() == hash_counts_of(texts[7].as_py()).tolist()
    assert spans.char_split(1000, 100).func(texts)[300].as_py() == spans.char_split_of(texts[300].as_py(), 1000, 100)


def test_java_white_space_is_the_same(spark):
    """The quick class for Java and the one shared with SQL hold the same characters; citations go with the blanks before them."""
    points = spark.range(0x110000).where("id < 55296 OR id > 57343").select(
        F.decode(F.to_binary(F.lpad(F.hex("id"), 8, "0"), F.lit("hex")), "UTF-32").alias("c"))
    for java, shared in ((patterns.JAVA_WS, patterns.WS), (patterns.JAVA_WS_INLINE, patterns.WS_INLINE)):
        assert points.where(F.col("c").rlike(java) != F.col("c").rlike(shared)).count() == 0
    assert points.where(F.col("c").rlike(patterns.JAVA_WS)).count() == 29
    cite = "cr_" + "aB0" * 6 + "9f"
    said = [f"a [ {cite} ] .", f"a [ [\u3000{cite}\xa0][{cite}]b", f"a\u2003 XATT_{'0' * 20}] ;c", f"[ [ {cite[:-1]} ]"]
    want = ["a.", "a [ b", "a\u2003 X;c", f"[ [ {cite[:-1]} ]"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", text.visible_text(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == want


def test_counted_tokens_equal_the_tokens(spark):
    """Words, numbers and letter pairs counted by the helper are those of the token list; the plan makes no list of them."""
    from tracewell.operators import lexical

    said = ["", None, "a", "Ab ab AB ab1.5,2 1.5 ٣٤,5", "매출ㆍ원가 1,250.5 매출", "x\U0001f600yz é end", "가a힣 z", "ab " * 700, "한글만 있는 글", "İstanbul ǅ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said * 60)], "i int, t string").coalesce(1)
    want = {(r["i"], r["term"]): r["tf"] for r in lexical.term_frequency(lexical.tokenized(df, "i", F.col("t")), "i").collect()}
    counts = lexical.text_counts(df, "i", F.col("t"))
    rows = counts.collect()
    got = {(r["i"], x["term"]): x["tf"] for r in rows for x in r["counts"]}
    assert got == want and len(rows) == 600 and sum(len(r["counts"]) for r in rows) == len(want)
    assert rows[0]["counts"] == [] and "regexp_extract_all" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_the_queries_are_counted_by_the_helper(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["term_freq"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan


def test_columns_are_counted_in_their_row(spark):
    """As by one group per key and column, also for repeated keys and empty grids; cells are neither rows nor groups."""
    from tracewell.operators import layout

    grids = [(1, [[1, 2, 3], [4], [5, 6]]), (2, []), (1, [[7], [8, 9, 10, 11]]), (None, [[1]]), (3, [[], [2]]), (4, None), (None, [[5, 5], [6]]), (1, [[2]])] + [
        (10 + i, [[i] * (i % 5 + 1)] * (i % 3)) for i in range(600)]
    df = spark.createDataFrame(grids, "k int, x array<array<int>>").coalesce(1)
    cells = df.select("k", F.posexplode("x").alias("r", "l")).select("k", "r", F.posexplode("l").alias("c", "v"))
    want = cells.groupBy("k", F.concat(F.lit("c"), F.col("c").cast("string")).alias("column_id")).agg(
        F.count(F.lit(1)).alias("cells"), F.max("r").alias("last_row"), F.sum("v").alias("chars"))
    got = layout.unpivoted(df, "k", "x").select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

    import __spark_entry__ as entry
    plan = entry.queries()["unpivot_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "column_id" not in plan[plan.index("Exchange"):]
