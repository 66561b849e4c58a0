import os
import random

from pyspark.sql import functions as F

from tracewell.operators import evidence
from tracewell.session import shared_folder


def test_conflict_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    words = [a + b for a in "abcdefg" for b in "xyz"]

    def text():
        said = rng.sample(words, rng.randint(1, 8)) + [str(rng.randint(10, 13)) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.4:
            said.append(str(rng.choice([2020, 2021])))
        rng.shuffle(said)
        return " ".join(said)

    data = [(i, rng.choice(["t1", "t1", "t2"]), "credit" if i % 3 == 0 else "att", text()) for i in range(150)]
    data += [(i, data[i % 40][1], rng.choice(["credit", "att"]), data[i % 40][3]) for i in range(150, 260)]  # copies
    df = spark.createDataFrame(data, "id long, tenant string, side string, content string")
    parts = [evidence.conflict_features(df.where(F.col("side") == s), ["tenant"], "id", "content", [], []) for s in ("credit", "att")]
    found = evidence.Conflicts(*parts, ["tenant"])
    got = {(r["credit_id"], r["attachment_id"]) for r in found.pairs().collect()}

    def features(t):
        parts = t.split()
        return ({p for p in parts if p.isalpha()}, {p for p in parts if p.isdigit()}, {p for p in parts if p.isdigit() and len(p) == 4})

    want = set()
    for c in data:
        for a in data:
            if c[2] != "credit" or a[2] != "att" or c[1] != a[1]:
                continue
            (ct, cn, cy), (at, an, ay) = features(c[3]), features(a[3])
            if not (ct and cn and at and an) or cn == an or (cy and ay and not cy & ay):
                continue
            common = len(ct & at)
            if (common >= 2 and common / len(ct | at) >= 0.2) or (cy & ay and common >= 1):
                want.add((c[0], a[0]))
    assert len(want) > 50
    assert got == want
    marks = {r["id"]: (r["conflicts_with_credit"], r["conflicting_attachments"]) for r in found.annotate(df.select("id"), "id").collect()}
    for i, _, side, _ in data:
        partners = sorted([a for c, a in want if c == i] + [c for c, a in want if a == i])
        assert marks[i] == ((partners, []) if side == "att" else ([], partners))


def _sides(spark, data):
    df = spark.createDataFrame(data, "id long, tenant string, side string, content string")
    return df, [evidence.conflict_features(df.where(F.col("side") == s), ["tenant"], "id", "content", [], []) for s in ("credit", "att")]


def test_small_scopes_write_no_features(spark):
    data = [(4 * k + j, f"t{k}", side, f"alpha beta {said}") for k in range(500) for j, (side, said) in enumerate(
        [("credit", 10), ("att", 11), ("att", 10), ("credit", 12)])]
    df, parts = _sides(spark, data)
    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names if not n.endswith(".crc"))
    before = size()
    marks = {r["id"]: (r["conflicts_with_credit"], r["conflicting_attachments"]) for r in evidence.Conflicts(*parts, ["tenant"]).annotate(df.select("id"), "id").collect()}
    assert size() - before < 20_000  # the features written down took 80 kB
    assert marks[40] == ([], [41]) and marks[41] == ([40, 43], []) and marks[42] == ([43], []) and marks[43] == ([], [41, 42]) and len(marks) == 2000


def test_pairs_do_not_depend_on_where_scopes_are_decided(spark):
    rng = random.Random(5)
    words = [a + b for a in "abcdefg" for b in "xyz"]
    data = [(i, f"t{min(i % 9, 2 + i % 2)}", rng.choice(["credit", "att"]), " ".join(rng.sample(words, rng.randint(1, 6)) + [rng.choice(["10", "11", "2020", "2021"])])) for i in range(240)]
    data += [(240 + i, *data[i][1:]) for i in range(60)]  # copies
    _, parts = _sides(spark, data)
    some = evidence.Conflicts(*parts, ["tenant"], direct=1500)  # both kinds of scope
    assert some.groups is not None and some.small["credit"].count() > 0
    rows = [sorted(map(tuple, c.pairs().collect())) for c in (evidence.Conflicts(*parts, ["tenant"], direct=0), some, evidence.Conflicts(*parts, ["tenant"], direct=10**9))]
    assert len(rows[0]) > 100 and rows[0] == rows[1] == rows[2]


def test_pairs_of_rows_equal_those_of_two_sides(spark):
    data = [(i, None if i % 17 == 0 else f"t{i % 9}", None if i % 13 == 0 else i % 9 > 6 or i % 2 == 0, f"alpha {'beta' if i % 4 else 'gamma'} {10 + i % 5}") for i in range(120)]
    df = spark.createDataFrame(data, "id long, tenant string, credit boolean, content string")
    of = lambda rows: evidence.conflict_features(rows, ["tenant"], "id", "content", [], [])
    want = sorted(map(tuple, evidence.Conflicts(of(df.where("credit")), of(df.where("NOT credit")), ["tenant"]).pairs().collect()))
    for direct in (0, 30, 4096):
        found = evidence.Conflicts.of_rows(df, ["tenant"], "credit", of, direct=direct)
        assert sorted(map(tuple, found.pairs().collect())) == want
    assert len(want) > 50 and not {row[0] for row in want} & {"t7", "t8"}


def greedy(rows, budget, share=0.5):
    """Plain restatement on the full list, without the pre-cut."""
    ranked = sorted(rows, key=lambda r: (-r["score"], r["key"]))

    def novel(entries, seen):
        seen, fresh, repeat = set(seen), [], []
        for r in entries:
            (repeat if r["view"] in seen else fresh).append(r)
            seen.add(r["view"])
        return fresh + repeat

    credit = [r for r in ranked if r["credit"]]
    target = min(sum(r["cost"] for r in credit), int(budget * share))
    used = credit_used = 0
    taken, views = set(), set()
    for r in novel(credit, ()):
        if credit_used >= target:
            break
        if used + r["cost"] <= budget:
            taken.add(r["key"])
            views.add(r["view"])
            used += r["cost"]
            credit_used += r["cost"]
    for r in novel([r for r in ranked if r["key"] not in taken], views):
        if used + r["cost"] <= budget:
            taken.add(r["key"])
            used += r["cost"]
    return taken


def test_budget_selection_equals_full_greedy(spark):
    rng = random.Random(11)
    data = []
    for case in range(12):
        for _ in range(rng.randint(1, 400)):
            credit = rng.random() < 0.4
            data.append((case, len(data), rng.randint(0, 30) / 10, rng.choice([20, 25, 40, 41, 90, 300]),
                         "credit_report" if credit else "attachment", f"{credit}-{rng.randint(0, 25)}"))
    df = spark.createDataFrame(data, "case int, key long, score double, cost long, source_class string, view string")
    for budget in (100, 350, 1000):
        got = {}
        for r in evidence.select_within_budget(df, "case", group="view", score="score", key="key", cost="cost",
                                               source_class="source_class", budget=budget).collect():
            got.setdefault(r["case"], set()).add(r["key"])
        for case in range(12):
            rows = [dict(key=k, score=s, cost=c, credit=cl == "credit_report", view=v) for cs, k, s, c, cl, v in data if cs == case]
            assert got.get(case, set()) == greedy(rows, budget), (case, budget)


def test_assembly_routes_items_and_normalises_money(spark):
    facts = spark.createDataFrame([
        ("F1", "매출액", "1250", "천원", "2025", ["B"], False, "d1", "credit.xlsx", "S", "B2"),
        ("F2", "업종", "제조업체", None, None, [], True, "d1", "credit.xlsx", "S", "B3"),
        ("F3", "자본", "(2000)", "백만원", None, ["A", "C"], True, "d1", "credit.xlsx", "S", "B4")],
        "fact_id string, field_name string, value string, unit string, period string, review_items array<string>, common boolean, "
        "document_id string, source_filename string, sheet_name string, cell_range string")
    hits = spark.createDataFrame([("B", "G1", "매출 164134131441원 증가", "d2", "a.pdf", [3], 0.8), ("B", "G2", None, None, None, None, None)],
                                 "review_item string, global_chunk_id string, document string, document_id string, source_filename string, pages array<int>, score double")
    rows = evidence.assemble(facts, hits).collect()
    by_item = {}
    for r in rows:
        by_item.setdefault(r["review_item"], []).append(r)
    assert sorted(by_item) == ["A", "B", "C", "D", "E"]
    text = {r["content"] for r in rows}
    assert "매출액=1.3; 단위=백만원; 기간=2025" in text and "자본=-2,000; 단위=백만원" in text and "업종=제조업체" in text
    assert "매출 164,134.1백만원 증가" in text
    assert {r["source_tier"] for r in by_item["A"]} == {2}
    assert [r["document_id"] for r in rows if r["content"] == ""] == ["unknown"]
    assert all(r["evidence_id"].startswith(("CR_", "ATT_")) for r in rows)


def test_examples_prefer_exact_loan_and_industry(spark):
    examples = spark.createDataFrame([
        ("exact", "B", "APPROVED", ["운전자금"], ["C29"], ["growth"]), ("industry", "B", "APPROVED", ["*"], ["C"], []),
        ("draft", "B", "DRAFT", ["운전자금"], ["C29"], ["growth"]), ("other", "A", "APPROVED", [], [], []), ("none", "B", "APPROVED", ["시설"], [], [])],
        "example_id string, review_item string, approval_status string, loan_types array<string>, industry_codes array<string>, tags array<string>")
    cases = spark.createDataFrame([("c1", "B", "운전자금", "C29", ["growth"])],
                                  "c string, review_item string, loan_type string, industry_code string, tags array<string>")
    got = evidence.select_examples(cases, examples, case="c").orderBy("rank").collect()
    assert [(r["example_id"], r["score"]) for r in got] == [("exact", 24), ("industry", 6)]


def test_cross_signals_korean_defaults(spark):
    rows = spark.createDataFrame([("c", "B", "영업이익 증가"), ("c", "D", "현금흐름 악화"), ("c", "A", "차입금"), ("c", "C", "자본 확충"), ("d", "B", "영업이익")],
                                 "c string, i string, t string")
    got = {(r["c"], r["signal"]) for r in evidence.cross_signals(rows, "c", "i", "t").collect()}
    assert got == {("c", "PROFIT_CASHFLOW_ALIGNMENT"), ("c", "DEBT_CAPITAL_BALANCE")}
