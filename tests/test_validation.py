from pyspark.sql import functions as F

from tracewell.operators import claims, prompts, reasoning, validation

A, B, C = "CR_" + "a" * 20, "ATT_" + "b" * 20, "CR_" + "c" * 20


def test_issue_codes(spark):
    sections = spark.createDataFrame([
        ("ok", f"매출액은 100백만원이다. [{A}]"), ("none", "매출액은 100백만원이다."), ("wrong", f"매출액은 250백만원이다 [{A}]."),
        ("rival", f"매출액은 300백만원이다 [{B}]."), ("leak", f"성장률 77% 가나상사 [{A}].")], "section string, text string")
    evidence = spark.createDataFrame(
        [(s, A, "매출액=100; 단위=백만원") for s in ("ok", "none", "wrong", "leak")] + [("rival", B, "매출 300백만원"), ("rival", C, "매출액=280백만원")],
        "section string, evidence_id string, content string")
    examples = spark.createDataFrame([(s, "성장률 77% 달성", ["가나상사", "없음"]) for s in ("ok", "leak")],
                                     "section string, output_example string, forbidden_tokens array<string>")
    conflicts = spark.createDataFrame([("rival", B, C)], "section string, evidence_id string, credit_id string")
    got = {(r["section"], r["code"], r["detail"]) for r in validation.validate_sections(sections, evidence, examples, conflicts).collect()}
    assert got == {
        ("none", "missing_evidence_citation", ""), ("none", "numeric_claim_without_citation", "100백만원"),
        ("wrong", "unsupported_numeric_fact", "250백만원"), ("rival", "credit_report_direct_conflict", "300백만원"),
        ("leak", "unsupported_numeric_fact", "77%%"), ("leak", "few_shot_numeric_leakage", "77%%"), ("leak", "few_shot_token_leakage", "가나상사")}


def test_cross_sections(spark):
    rows = spark.createDataFrame([("k", "A", "2024년 매출액 100백만원."), ("k", "B", "2024년 매출액 120백만원."), ("k", "C", "매출액 90백만원."), ("m", "A", "2024년 매출액 100백만원.")],
                                 "case string, item string, text string")
    got = validation.cross_section_conflicts(rows).collect()
    assert [(r["case"], r["low"], r["high"]) for r in got] == [("k", "100", "120")]


def test_claims_binding_and_patches(spark):
    sections = spark.createDataFrame([("s", "A", f"첫째 {A}. 둘째 3.5% {C}. 셋째")], "section string, item string, text string")
    parts = claims.segment_claims(sections, "section", F.array(F.lit(A)))
    rows = parts.orderBy("start").collect()
    assert [r["claim_id"] for r in rows] == ["A-001", "A-002", "A-003"] and [r["evidence_ids"] for r in rows] == [[A], [], []]
    evidence = spark.createDataFrame([("s", A), ("s", B)], "section string, evidence_id string")
    bound = {(r["claim_id"], r["evidence_id"]) for r in claims.bind_evidence(parts, evidence, "section").collect()}
    assert bound == {("A-001", A), ("A-002", A), ("A-002", B), ("A-003", A), ("A-003", B)}
    df = spark.createDataFrame([("0123456789",)], "t string")
    patches = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(x).alias("text")) for a, b, x in ((6, 8, "-"), (1, 3, "LONGER"))])
    assert df.select(claims.apply_patches(F.col("t"), patches, 2)).first()[0] == "0LONGER345-89"
    assert df.select(claims.apply_patches(F.col("t"), patches)).first()[0] == "0LONGER3456789"


def test_prompt_budgets(spark):
    budget = prompts.TokenBudget()
    assert budget.input == 23172 and budget.style_cap == 4200 and budget.evidence(30000) == 700
    rows = spark.createDataFrame([("q", i, f"v{i % 2}", 10, 100) for i in range(20)], "q string, r int, g string, h int, e int")
    kept = prompts.fit_prefix(rows, ["q"], [("r", True)], "g", "h", "e", 22000, budget).count()
    # 101 chars per row and 12 more for each new view must stay within 1172 tokens.
    want = max(n for n in range(1, 21) if -(-(101 * n + 12 * min(n, 2)) * 10 // 17) + 22000 <= 23172)
    assert kept == want
    styles = spark.createDataFrame([("q", 1, "x" * 8000), ("q", 2, "y" * 100), ("q", 3, "z" * 10)], "q string, n int, t string")
    assert sorted(r["n"] for r in prompts.keep_styles(styles, ["q"], "n", F.col("t"), budget).collect()) == [1]
    facts = spark.createDataFrame([("q", i, "f", str(i), None, "2024") for i in range(70)], "q string, position int, field_name string, value string, unit string, period string")
    hits = spark.createDataFrame([("q", 1, None, [3], "본문")], "q string, rank int, source_filename string, pages array<int>, document string")
    context = prompts.case_context(facts, hits, ["q"]).first()["context"]
    assert context.startswith("신용조사서 | f=0 | 기간=2024\n\n") and context.endswith("첨부자료 | 업로드 자료 | 페이지=3\n본문") and "f=60" not in context


def test_generator_plans_are_whitelisted(spark):
    import json

    issues = [{"title": "no ids", "evidence_ids": ["x"]}, {"title": "low", "materiality": "LOW", "evidence_ids": [A]}] + [
        {"title": f"t{i}", "materiality": "high", "evidence_ids": ["x", A, B]} for i in range(7)]
    reply = "생각: ```" + json.dumps({"items": {"A": {"judgment_focus": "f", "priority_issues": issues}, "B": {"priority_issues": issues[:1]}},
                                    "cross_item_signals": [{"type": "S", "evidence_ids": [C, "x"]}, {"type": "T", "evidence_ids": ["x"]}]}) + "```"
    replies = spark.createDataFrame([("k", reply), ("m", "no json"), ("n", "{broken")], "case string, reply string")
    evidence = spark.createDataFrame([("k", "A", A), ("k", "A", B), ("k", "C", C)], "case string, review_item string, evidence_id string")
    got = reasoning.accept_issues(replies, evidence)
    assert [(r["review_item"], r["rank"], r["title"], r["materiality"], r["evidence_ids"]) for r in got.orderBy("rank").collect()] == [
        ("A", n, f"t{n - 1}", "HIGH", [A, B]) for n in range(1, 6)]
    fallback = spark.createDataFrame([("k", "A", 1, "unused"), ("k", "B", 1, "fallback")], "case string, review_item string, rank int, title string")
    assert {(r["review_item"], r["title"]) for r in reasoning.with_fallback(got, fallback).where("rank = 1").collect()} == {("A", "t0"), ("B", "fallback")}
    signals = reasoning.accept_signals(replies, evidence).orderBy("rank").collect()
    assert [(r["type"], r["evidence_ids"]) for r in signals] == [("S", [C]), ("T", [])]


def test_the_judged_one_of_equal_sentences_is_patched(spark):
    said = "매출은 100이다. 매출은 100이다.\n끝. 😀 매출은 100이다."
    sections = spark.createDataFrame([("s", "A", said), ("empty", "A", ""), ("none", "A", None)], "section string, item string, text string")
    evidence = spark.createDataFrame([("s", A)], "section string, evidence_id string")
    reply = {"status": "FAIL", "severity": "MINOR", "reason_code": "UNIT_MISMATCH", "span": "100", "replacement": "200"}

    def judge(parts, which, ids=(A,), **other):
        hit = F.col("claim_id").isin(*which)
        own = {k: F.when(hit, v).otherwise({"status": "PASS", "severity": "MINOR"}.get(k, "")) for k, v in {**reply, **other}.items()}
        return parts.withColumns(own).withColumn("said_ids", F.array(*map(F.lit, ids)))

    def run(mode, which, most=1, **other):
        return {r.section: (r.text, r.findings, r.failing, r.patched) for r in claims.verified(sections, evidence, lambda p: judge(p, which, **other), mode, most=most).collect()}

    ids = [r.claim_id for r in claims.bound_claims(sections, evidence).orderBy("start").collect()]
    assert len(ids) == 4
    assert run("ENFORCE", [ids[1]])["s"] == ("매출은 100이다. 매출은 200이다.\n끝. 😀 매출은 100이다.", 4, 1, True)
    assert run("ENFORCE", [ids[3]])["s"] == ("매출은 100이다. 매출은 100이다.\n끝. 😀 매출은 200이다.", 4, 1, True)
    assert run("ENFORCE", [ids[0], ids[3]])["s"][:3] == ("매출은 200이다. 매출은 100이다.\n끝. 😀 매출은 100이다.", 4, 2)
    assert run("ENFORCE", [ids[0], ids[3]], most=2, replacement="2,000")["s"][0] == "매출은 2,000이다. 매출은 100이다.\n끝. 😀 매출은 2,000이다."
    assert run("SHADOW", [ids[1]])["s"] == (said, 4, 1, False) and run("OFF", [ids[1]])["s"] == (said, 0, 0, False)
    assert run("ENFORCE", [ids[1]], ids=("elsewhere",))["s"] == (said, 4, 0, False)
    assert run("ENFORCE", [ids[1]])["empty"] == ("", 0, 0, False) and run("ENFORCE", [ids[1]])["none"] == (None, 0, 0, False)
