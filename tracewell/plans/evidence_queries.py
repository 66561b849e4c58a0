"""Index maintenance, evidence ranking, selection and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.vectors import hash_counts
from tracewell.operators import claims, evidence, grouping, retrieval, upsert
from tracewell.operators.prompts import evidence_block, within_budget
from tracewell.operators.scoring import search
from tracewell.plans.registry import Tables, query
from tracewell.plans.retrieval_queries import SQL_DENSE
from tracewell.plans.text_queries import PARTICLES, STOP, sql_clean, sql_numbers, sql_terms, sql_years

WEIGHTS = {
    "A": {"the": 1.5, "tion": 0.8, "qu": 0.9}, "B": {"en": 1.2, "und": 1.7}, "C": {"que": 1.8, "of": 0.5, "license": 1.3},
    "D": {"ment": 2.0, "token": 1.5}, "E": {"der": 1.7, "and": 1.1, "xyzzy": 2.0},
}
SIGNALS = {
    "FIRST": ({"A": ["xtion", "the"]}, {"D": ["ment"]}),
    "SECOND": ({"B": ["token"], "C": ["token"]}, {"C": ["und"]}),
    "THIRD": ({"E": ["License"]}, {"A": ["que"]}),
}
SQL_SCOPED = "SELECT lang AS tenant_id, source AS case_id, CAST(doc_id AS VARCHAR) AS document_id"


def _index(t: Tables):
    return t.documents.select(
        F.col("lang").alias("tenant_id"), F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").alias("chunk_no"), F.col("text").alias("embedding_text"))


@query("index_upsert", f"""
WITH cur AS ({SQL_SCOPED}, doc_id AS chunk_no, text AS embedding_text FROM documents),
new AS (SELECT c.tenant_id, c.case_id, c.document_id, c.chunk_no + r.k * 1000000 AS chunk_no, 'v2 ' || embedding_text AS embedding_text
        FROM cur c JOIN labels ON doc_id = chunk_no, range(2) r(k) WHERE quality = 1)
SELECT tenant_id, case_id, document_id, chunk_no, sha256(embedding_text) AS text_sha FROM cur ANTI JOIN new USING (tenant_id, case_id, document_id)
UNION ALL SELECT tenant_id, case_id, document_id, chunk_no, sha256(embedding_text) FROM new""")
def index_upsert(t: Tables):
    current = _index(t)
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("chunk_no"))
    newer = current.join(good, "chunk_no").withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "chunk_no": F.col("chunk_no") + F.col("_k") * 1000000,
        "embedding_text": F.concat(F.lit("v2 "), "embedding_text")}).drop("_k")
    return upsert.replace_documents(current, newer).select(
        "tenant_id", "case_id", "document_id", "chunk_no", F.sha2("embedding_text", 256).alias("text_sha"))


@query("scoped_delete", """
SELECT source AS case_id, count(*) AS before, count(*) FILTER (WHERE NOT (lang = 'en' AND source = 'src7')) AS after,
  count(*) FILTER (WHERE lang = 'en' AND source = 'src7') AS deleted FROM documents GROUP BY source""")
def scoped_delete(t: Tables):
    current = _index(t)
    kept = upsert.delete_scope(current, {"tenant_id": "en", "case_id": "src7"})
    before = current.groupBy("case_id").agg(F.count(F.lit(1)).alias("before"))
    after = kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("after"))
    joined = before.join(after, "case_id", "left").fillna(0, ["after"])
    return joined.withColumn("deleted", F.col("before") - F.col("after"))


@query("index_stats", """
SELECT lang AS tenant_id, source AS case_id, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY ALL""")
def index_stats(t: Tables):
    return upsert.index_stats(_index(t), ["tenant_id", "case_id"])


@query("table_stats", "\nUNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in
       ("documents", "conversations", "events", "orders", "lineitem", "embeddings")))
def table_stats(t: Tables):
    names = ("documents", "conversations", "events", "orders", "lineitem", "embeddings")
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dup_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dup_keys(t: Tables):
    return upsert.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("missing_keys", """
SELECT conv_id, turn, list_sort(list_filter(['assistant', 'system', 'the', 'user', 'que'], lambda x: x <> role AND NOT list_contains(string_split(text, ' '), x))) AS missing,
FROM conversations""".replace("AS missing,\n", "AS m\n").replace("SELECT conv_id, turn, list_sort(", "SELECT conv_id, turn, array_to_string(m, ',') AS missing FROM (SELECT conv_id, turn, list_sort(") + ")")
def missing_keys(t: Tables):
    present = F.concat(F.array("role"), F.split("text", " "))
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(
        upsert.missing_values(["assistant", "system", "the", "user", "que"], present)), ",").alias("missing"))


@query("embed_missing", """
WITH d AS (SELECT lang, sha256(text) AS h, doc_id FROM documents),
k AS (SELECT h FROM d JOIN labels USING (doc_id))
SELECT DISTINCT h AS content_hash FROM d WHERE h NOT IN (SELECT h FROM k)""")
def embed_missing(t: Tables):
    chunks = t.documents.select("doc_id", text.exact_hash(F.col("text")).alias("content_hash"))
    return upsert.unseen_contents(chunks, chunks.join(t.labels.select("doc_id"), "doc_id", "left_semi"), ["content_hash"])


# --- conflicts ------------------------------------------------------------------------------

# Evidence of an order as case and a return flag as item: the name of the part, a size, often a year.
SQL_CONFLICT = f"""
WITH e AS (SELECT l_orderkey, l_returnflag, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS evidence_id, l_linestatus = 'O' AS credit,
   p_name || ' ' || p_type || ' size ' || CAST(l_quantity AS INTEGER) || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE ' in ' || (1993 + l_suppkey % 3) || '년' END AS text
   FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT *, {sql_terms('text')} AS t, list_sort(list_distinct({sql_numbers('text')})) AS n, list_distinct({sql_years('text')}) AS y FROM e),
g AS (SELECT * FROM f WHERE len(t) > 0 AND len(n) > 0),
p AS (SELECT c.l_orderkey, c.l_returnflag, c.evidence_id AS credit_id, a.evidence_id AS attachment_id, len(list_intersect(c.t, a.t)) AS common,
   len(list_distinct(list_concat(c.t, a.t))) AS u, len(c.y) > 0 AND len(a.y) > 0 AS dated, list_has_any(c.y, a.y) AS same
   FROM g c JOIN g a ON c.l_orderkey = a.l_orderkey AND c.l_returnflag = a.l_returnflag AND c.credit AND NOT a.credit WHERE c.n <> a.n),
k AS (SELECT * FROM p WHERE NOT (dated AND NOT same) AND ((common >= 2 AND common / u >= 0.2) OR (dated AND same AND common >= 1)))"""


def _evidence_rows(t: Tables):
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_returnflag", (F.col("l_linestatus") == "O").alias("credit"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), name


def _conflicts(t: Tables):
    (lines, name), scope = _evidence_rows(t), ["l_orderkey", "l_returnflag"]

    def features(rows):
        year = F.concat(F.lit(" in "), (F.lit(1993) + F.col("l_suppkey") % 3).cast("string"), F.lit("년"))
        said = F.concat("p_name", F.lit(" "), "p_type", F.lit(" size "), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(year))
        texts = rows.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey").select(*scope, name.alias("evidence_id"), said.alias("text"))
        return evidence.conflict_features(texts, scope, "evidence_id", "text", STOP, PARTICLES)

    return evidence.Conflicts.of_rows(lines, scope, "credit", features)


@query("conflict_pairs", SQL_CONFLICT + " SELECT l_orderkey, l_returnflag, credit_id, attachment_id, common FROM k")
def conflict_pairs(t: Tables):
    return _conflicts(t).pairs()


@query("conflict_annotate", SQL_CONFLICT + """,
a AS (SELECT attachment_id AS evidence_id, string_agg(credit_id, ',' ORDER BY credit_id) AS c FROM k GROUP BY ALL),
c AS (SELECT credit_id AS evidence_id, string_agg(attachment_id, ',' ORDER BY attachment_id) AS a FROM k GROUP BY ALL)
SELECT evidence_id, coalesce(a.c, '') AS conflicts_with_credit, coalesce(c.a, '') AS conflicting_attachments FROM e LEFT JOIN a USING (evidence_id) LEFT JOIN c USING (evidence_id)""")
def conflict_annotate(t: Tables):
    lines, name = _evidence_rows(t)
    rows = lines.join(t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select(name.alias("evidence_id"))
    found = _conflicts(t).annotate(rows, "evidence_id")
    return found.select("evidence_id", *[F.array_join(c, ",").alias(c) for c in ("conflicts_with_credit", "conflicting_attachments")])


# --- ranking and selection ------------------------------------------------------------------

SQL_SCORED = f"""
WITH q AS (SELECT 'src' || item_id AS source, {sql_terms('text')} AS qt FROM benchmark),
e AS (SELECT d.*, CASE WHEN lang = 'en' THEN 'credit_report' ELSE 'attachment' END AS source_class, quality, toxic, {sql_terms('text')} AS t FROM documents d LEFT JOIN labels USING (doc_id)),
x AS (SELECT e.*, CASE WHEN len(t) = 0 OR len(qt) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(t, qt)) / greatest(1.0::DOUBLE, sqrt(CAST(len(t) * len(qt) AS DOUBLE))) END AS lex,
   CASE WHEN source_class = 'attachment' THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (n_chars % 300) / 100.0::DOUBLE - 1.0::DOUBLE)) ELSE 0.0::DOUBLE END AS vec FROM e JOIN q USING (source)),
s AS (SELECT doc_id, source, source_class, lang, text, n_chars, round(lex + greatest(0.0::DOUBLE, vec) * 0.35::DOUBLE
   + CASE WHEN quality = 1 AND toxic = 0 THEN 1.5::DOUBLE WHEN toxic = 1 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n_chars % 11 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END, 9) AS score,
   source_class || ':' || (n_chars // 500) AS grp FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY source, grp ORDER BY rank) = 1 AS is_first FROM r)"""


def _scored(t: Tables):
    queries = t.benchmark.select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("source"),
                                 text.terms(F.col("text"), STOP, PARTICLES).alias("qt"))
    rows = t.spread("documents").join(t.labels, "doc_id", "left").withColumns({
        "source_class": F.when(F.col("lang") == "en", "credit_report").otherwise("attachment"),
        "t": text.terms(F.col("text"), STOP, PARTICLES)})
    scored = rows.join(queries, "source").withColumn("score", evidence.selection_score(
        F.col("qt"), F.col("t"), F.col("source_class"), (F.col("n_chars") % 300) / F.lit(100.0) - 1.0,
        (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("toxic") == 1, F.col("n_chars") % 11 == 0))
    group = F.concat(F.col("source_class"), F.lit(":"), F.floor(F.col("n_chars") / 500).cast("string"))
    return scored.select("doc_id", "source", "source_class", "score", group.alias("grp"),
                         (text.token_estimate(F.col("text")) + 10).alias("cost"))


@query("evidence_rank", SQL_SCORED + " SELECT source, rank, doc_id, round(score, 6) AS score FROM r")
def evidence_rank(t: Tables):
    ranked = evidence.rank_evidence(_scored(t), "source", "score", "doc_id")
    return ranked.select("source", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("novelty_order", SQL_SCORED + """
SELECT source, doc_id, is_first, row_number() OVER (PARTITION BY source ORDER BY is_first DESC, rank) AS position FROM f""")
def novelty_order(t: Tables):
    ordered = evidence.novelty_order(_scored(t), "source", "grp", "score", "doc_id")
    return ordered.select("source", "doc_id", "is_first", "position")


BUDGET = 6000


@query("budget_select", SQL_SCORED.replace("WITH q AS", "WITH RECURSIVE q AS", 1) + f""",
c AS (SELECT *, CAST(greatest(1, ceil(length(text) / 1.7)) AS BIGINT) + 10 AS cost FROM f),
t AS (SELECT source, least(CAST(sum(cost) AS BIGINT), {BUDGET // 2}) AS target FROM c WHERE source_class = 'credit_report' GROUP BY source),
o1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY is_first DESC, rank) AS n FROM c WHERE source_class = 'credit_report'),
p1 AS (SELECT source, 0::BIGINT AS n, 0::BIGINT AS used, []::BIGINT[] AS ids FROM (SELECT DISTINCT source FROM c)
  UNION ALL SELECT p1.source, o1.n, CASE WHEN used < target AND used + cost <= {BUDGET} THEN used + cost ELSE used END,
     CASE WHEN used < target AND used + cost <= {BUDGET} THEN list_append(ids, doc_id) ELSE ids END
     FROM p1 JOIN o1 ON o1.source = p1.source AND o1.n = p1.n + 1 JOIN t ON t.source = p1.source),
e1 AS (SELECT source, max_by(used, n) AS used, max_by(ids, n) AS ids FROM p1 GROUP BY source),
seen AS (SELECT DISTINCT c.source, grp FROM c JOIN e1 USING (source) WHERE list_contains(ids, doc_id)),
rest AS (SELECT c.*, c.is_first AND seen.grp IS NULL AS fresh FROM c JOIN e1 USING (source) LEFT JOIN seen ON seen.source = c.source AND seen.grp = c.grp WHERE NOT list_contains(ids, doc_id)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fresh DESC, rank) AS n FROM rest),
p2 AS (SELECT source, 0::BIGINT AS n, used, []::BIGINT[] AS ids FROM e1
  UNION ALL SELECT p2.source, o2.n, CASE WHEN used + cost <= {BUDGET} THEN used + cost ELSE used END, CASE WHEN used + cost <= {BUDGET} THEN list_append(ids, doc_id) ELSE ids END
     FROM p2 JOIN o2 ON o2.source = p2.source AND o2.n = p2.n + 1),
e2 AS (SELECT source, max_by(ids, n) AS ids FROM p2 GROUP BY source)
SELECT source, doc_id, cost, 1 AS pass FROM c JOIN e1 USING (source) WHERE list_contains(ids, doc_id)
UNION ALL SELECT source, doc_id, cost, 2 FROM c JOIN e2 USING (source) WHERE list_contains(ids, doc_id)""")
def budget_select(t: Tables):
    chosen = evidence.select_within_budget(
        _scored(t), "source", group="grp", score="score", key="doc_id", cost="cost", source_class="source_class", budget=BUDGET)
    return chosen.select(F.col("case").alias("source"), F.col("key").alias("doc_id"), "cost", "pass")


def _budget_blocks(t: Tables):
    docs = t.spread("documents").withColumn("vector", hash_counts("text"))
    queries = t.benchmark.withColumn("vector", hash_counts("text"))
    hits = search(docs, queries, k=10, by="dense", doc=("doc_id", "vector"), query=("item_id", "vector"))
    held = retrieval.with_documents(hits, t.documents.select(F.col("doc_id").alias("id"), "text", "source"))
    key = F.col("id").cast("string")
    return held.withColumn("cost", F.length(evidence_block(
        query_id=F.col("query_id"), level=F.lit(0), rank=F.col("rank"), global_id=key, local_id=key, document_id=key,
        filename=F.col("source"), pages=F.lit("[]"), content=F.col("text"))))


@query("budget_prefix", f"""
WITH {SQL_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS rank FROM ds),
b AS (SELECT item_id, rank, doc_id, length('[근거 ' || rank || ']' || chr(10) || 'evidence_id=' || item_id || '-L0-R' || rank || chr(10) || 'global_chunk_id=' || doc_id || chr(10)
  || 'local_chunk_id=' || doc_id || chr(10) || 'document_id=' || doc_id || chr(10) || 'source_filename=' || source || chr(10) || 'source_pages=[]' || chr(10) || 'content:' || chr(10) || text || chr(10)) AS cost
  FROM r JOIN documents USING (doc_id) WHERE rank <= 10),
u AS (SELECT *, sum(cost) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM b)
SELECT item_id AS query_id, rank, doc_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 5000 OR rank = 1""")
def budget_prefix(t: Tables):
    kept = within_budget(_budget_blocks(t), ["query_id"], [("rank", True)], "cost", 5000, keep_first=True)
    return kept.select("query_id", "rank", F.col("id").alias("doc_id"), "used")


@query("chat_history", """
WITH u AS (SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations)
SELECT conv_id, turn, role, CAST(used AS BIGINT) AS used FROM u WHERE used <= 1500""")
def chat_history(t: Tables):
    turns = t.conversations.withColumn("cost", F.length("text"))
    kept = within_budget(turns, ["conv_id"], [("turn", False)], "cost", 1500, keep_first=False)
    return kept.select("conv_id", "turn", "role", "used")


# --- source views ---------------------------------------------------------------------------

SQL_VIEWS = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'purchase' AS credit FROM events),
v AS (SELECT *, CASE WHEN credit THEN 'credit_report' || chr(31) || event_type || chr(31) || 'S' || (k % 3) || chr(31) || ((k + 1 - 1) // 12)
   ELSE 'attachment' || chr(31) || event_type || chr(31) || (k % 4) || chr(31) ||
     CASE WHEN event_type = 'click' THEN 'table:T' || (k % 5) WHEN event_type = 'view' THEN 'location:p' || (k % 2) WHEN event_type = 'signup' THEN 'page'
          ELSE 'bbox:' || CAST(round_even(value * 5 / 90, 0) AS BIGINT) || ',' || CAST(round_even(k / 90.0::DOUBLE, 0) AS BIGINT) || ',' || CAST(round_even((value * 5 + 45) / 90, 0) AS BIGINT) || ',' || CAST(round_even((k + 45) / 90.0::DOUBLE, 0) AS BIGINT) END END AS key FROM e)"""


def _views(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    e = t.events.select("event_id", "user_id", "event_type", "value", k.alias("k"))
    box = F.array(F.col("value") * 5, F.col("k").cast("double"), F.col("value") * 5 + 45, F.col("k") + 45.0)
    e = e.withColumn("bbox", F.when(kind != "signup", box))
    return e.withColumn("key", grouping.view_key(
        F.when(kind == "purchase", "credit_report").otherwise("attachment"), kind,
        sheet=F.concat(F.lit("S"), (F.col("k") % 3).cast("string")), cell_range=F.concat(F.lit("B"), (F.col("k") + 1).cast("string")),
        page=F.col("k") % 4, table=F.when(kind == "click", F.concat(F.lit("T"), (F.col("k") % 5).cast("string"))),
        location=F.when(kind == "view", F.concat(F.lit("p"), (F.col("k") % 2).cast("string"))), bbox=F.col("bbox")))


@query("visual_groups", SQL_VIEWS + """,
g AS (SELECT user_id, key, min(event_id) AS first_id FROM v GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS ref_no FROM g)
SELECT event_id, user_id, ref_no, first_id AS representative_id FROM v JOIN n USING (user_id, key)""")
def visual_groups(t: Tables):
    rows = _views(t).withColumn("position", F.col("event_id"))
    return grouping.reference_numbers(rows, "user_id", "key", "position", "event_id").select(
        "event_id", "user_id", "ref_no", "representative_id")


@query("bbox_union", SQL_VIEWS + """
SELECT user_id, key, count(*) AS members, round(min(x0), 6) AS x0, min(y0) AS y0, round(max(x1), 6) AS x1, max(y1) AS y1 FROM (
  SELECT user_id, key, CASE WHEN event_type <> 'signup' THEN value * 5 END AS x0, CASE WHEN event_type <> 'signup' THEN k END AS y0,
   CASE WHEN event_type <> 'signup' THEN value * 5 + 45 END AS x1, CASE WHEN event_type <> 'signup' THEN k + 45 END AS y1 FROM v) GROUP BY ALL""")
def bbox_union(t: Tables):
    out = grouping.view_extent(_views(t), "user_id", "key", "bbox")
    return out.withColumns({"x0": F.round("x0", 6), "x1": F.round("x1", 6)})


# --- materiality ----------------------------------------------------------------------------

def _sql_weights() -> str:
    arms = []
    for i, (_, words) in enumerate(WEIGHTS.items()):
        total = "0.0::DOUBLE" + "".join(f" + CASE WHEN contains(text, '{w}') THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for w, v in words.items())
        arms.append(f"WHEN {i} THEN {total}")
    return "CASE doc_id % 5 " + " ".join(arms) + " END"


SQL_MATERIAL = f"""
WITH m AS (SELECT doc_id, source, chr(CAST(65 + doc_id % 5 AS INTEGER)) AS review_item, round_even({_sql_weights()}
   + least(0.7::DOUBLE, len({sql_numbers('text')}) * 0.08::DOUBLE)
   + CASE WHEN len(list_distinct({sql_years('text')})) >= 2 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n_chars % 13 = 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END
   + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (n_chars % 150) / 100.0::DOUBLE)) * 0.35::DOUBLE, 4) AS score FROM documents)"""


def _material(t: Tables):
    item = F.char(F.lit(65) + F.col("doc_id") % 5)
    docs = t.spread("documents").withColumn("review_item", item)
    return docs.select("doc_id", "source", "review_item", "text", evidence.materiality_score(
        F.col("review_item"), F.col("text"), F.col("n_chars") % 13 == 0, (F.col("n_chars") % 150) / F.lit(100.0), WEIGHTS).alias("score"))


@query("materiality", SQL_MATERIAL + """
SELECT doc_id, review_item, score, CASE WHEN score >= 2.4 THEN 'HIGH' WHEN score >= 1.25 THEN 'MEDIUM' ELSE 'LOW' END AS materiality FROM m""")
def materiality(t: Tables):
    return _material(t).select("doc_id", "review_item", "score", evidence.materiality(F.col("score")).alias("materiality"))


@query("priority_issues", SQL_MATERIAL + """,
r AS (SELECT *, CASE WHEN score >= 2.4 THEN 'HIGH' WHEN score >= 1.25 THEN 'MEDIUM' ELSE 'LOW' END AS materiality, row_number() OVER (PARTITION BY source, review_item ORDER BY score DESC, doc_id) AS rank FROM m),
a AS (SELECT *, max(CASE WHEN materiality <> 'LOW' THEN 1 ELSE 0 END) OVER (PARTITION BY source, review_item) AS any_m FROM r)
SELECT source, review_item, rank, doc_id, score, materiality FROM a WHERE (any_m = 1 AND materiality <> 'LOW' AND rank <= 5) OR (any_m = 0 AND rank <= 3)""")
def priority_issues(t: Tables):
    best = evidence.priority_issues(_material(t).drop("text"), ["source", "review_item"], "score", "doc_id")
    return best.select("source", "review_item", "rank", "doc_id", "score", "materiality")


@query("cross_signals", """
WITH d AS (SELECT source, chr(CAST(65 + doc_id % 5 AS INTEGER)) AS i, text FROM documents),
g AS (SELECT source, bool_or(i = 'A' AND (contains(text, 'xtion') OR contains(text, 'the'))) AND bool_or(i = 'D' AND contains(text, 'ment')) AS a,
  bool_or(i IN ('B', 'C') AND contains(text, 'token')) AND bool_or(i = 'C' AND contains(text, 'und')) AS b,
  bool_or(i = 'E' AND contains(text, 'License')) AND bool_or(i = 'A' AND contains(text, 'que')) AS c FROM d GROUP BY source)
SELECT source, 'FIRST' AS signal FROM g WHERE a UNION ALL SELECT source, 'SECOND' FROM g WHERE b UNION ALL SELECT source, 'THIRD' FROM g WHERE c""")
def cross_signals(t: Tables):
    rows = t.documents.withColumn("review_item", F.char(F.lit(65) + F.col("doc_id") % 5))
    return evidence.cross_signals(rows, "source", "review_item", "text", SIGNALS)


@query("fewshot_topn", """
WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'PROMO' WHEN 'MACHINERY' THEN 'SMALL' WHEN 'FURNITURE' THEN 'LARGE' ELSE 'NONE' END AS loan, CAST(c_nationkey AS VARCHAR) AS ind,
   [CASE WHEN c_acctbal > 5000 THEN 'red' ELSE 'blue' END, 'gear'] AS tags FROM customer),
e AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN [] WHEN p_size % 4 = 1 THEN ['*', p_type] ELSE [p_type] END AS loans, CASE WHEN p_size % 7 = 0 THEN [] WHEN p_size % 7 = 1 THEN ['*'] ELSE [replace(p_brand, 'Brand#', ''), CAST(p_size AS VARCHAR)] END AS codes,
   string_split(p_name, ' ') AS tags, p_size <> 13 AS ok FROM part),
p AS (SELECT DISTINCT loan, ind, tags FROM c),
x AS (SELECT p.loan, p.ind, p.tags, p_partkey, CASE WHEN len(loans) = 0 THEN 0 WHEN list_contains(loans, loan) THEN 10 WHEN list_contains(loans, '*') THEN 1 END AS ls,
   CASE WHEN len(codes) = 0 THEN 0 ELSE list_max(list_transform(codes, lambda k: CASE WHEN k = '*' THEN 1 WHEN k = ind THEN 12 WHEN starts_with(ind, k) OR starts_with(k, ind) THEN 4 + least(length(k), length(ind)) END)) END AS si,
   2 * len(list_intersect(list_distinct(p.tags), list_distinct(e.tags))) AS ts FROM p, e WHERE ok),
r AS (SELECT *, ls + si + ts AS score, row_number() OVER (PARTITION BY loan, ind, tags ORDER BY ls + si + ts DESC, p_partkey) AS rank FROM x WHERE ls IS NOT NULL AND si IS NOT NULL)
SELECT c_custkey, rank, p_partkey AS example_id, CAST(score AS INTEGER) AS score FROM c JOIN r USING (loan, ind, tags) WHERE rank <= 3""")
def fewshot_topn(t: Tables):
    segment, size = F.col("c_mktsegment"), F.col("p_size")
    cases = t.customer.select(
        "c_custkey", F.lit("B").alias("review_item"),
        F.when(segment == "BUILDING", "PROMO").when(segment == "MACHINERY", "SMALL").when(segment == "FURNITURE", "LARGE").otherwise("NONE").alias("loan_type"),
        F.col("c_nationkey").cast("string").alias("industry_code"),
        F.array(F.when(F.col("c_acctbal") > 5000, "red").otherwise("blue"), F.lit("gear")).alias("tags"))
    none = F.array().cast("array<string>")
    examples = t.spread("part").select(
        F.col("p_partkey").alias("example_id"), F.lit("B").alias("review_item"),
        F.when(size != 13, "APPROVED").otherwise("DRAFT").alias("approval_status"),
        F.when(size % 4 == 0, none).when(size % 4 == 1, F.array(F.lit("*"), "p_type")).otherwise(F.array("p_type")).alias("loan_types"),
        F.when(size % 7 == 0, none).when(size % 7 == 1, F.array(F.lit("*"))).otherwise(
            F.array(F.replace("p_brand", F.lit("Brand#"), F.lit("")), size.cast("string"))).alias("industry_codes"),
        F.split("p_name", " ").alias("tags"))
    return evidence.select_examples(cases, examples, case="c_custkey").select("c_custkey", "rank", "example_id", "score")


# --- validation -----------------------------------------------------------------------------

def _stated(t: Tables):
    said = F.concat(F.lit("in "), F.date_format("l_shipdate", "yyyy"), F.lit("년 the size was "),
                    F.col("l_quantity").cast("int").cast("string"), F.lit("백만원."))
    known = F.concat(F.when(F.col("p_brand") == "Brand#1", "2000년 ").otherwise(""), F.lit("size 1"), F.lit(", "),
                     F.col("p_size").cast("string"), F.when(F.col("p_type") == "PROMO", ".0 %s").otherwise("백만원"))
    lines = t.spread("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate").withColumn("text", said)
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace(known, "%s", "").alias("text"))
    stated = claims.explode_tokens(lines, "l_orderkey", "l_linenumber", "l_partkey").where("kind = 'number'")
    return stated, claims.explode_tokens(parts, "l_partkey")


SQL_GROUNDED = """EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = l_quantity
   AND (p_type = 'PROMO' OR true) AND (p_brand <> 'Brand#1' OR year(l_shipdate) = 2000))"""


@query("grounding", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS canonical, year(l_shipdate)::VARCHAR AS periods
FROM lineitem WHERE NOT {SQL_GROUNDED}""")
def grounding(t: Tables):
    stated, known = _stated(t)
    return claims.ungrounded(stated, known, ["l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "canonical", F.array_join("periods", ",").alias("periods"))


@query("grounded_claims", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS canonical FROM lineitem WHERE {SQL_GROUNDED}""")
def grounded_claims(t: Tables):
    stated, known = _stated(t)
    return claims.grounded(stated, known, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "canonical")


@query("contradictions", """
SELECT l_partkey, year(l_shipdate) AS period, l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS claims FROM lineitem
GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1 AND count(DISTINCT l_linestatus) > 1""")
def contradictions(t: Tables):
    rows = t.lineitem.withColumn("period", F.year("l_shipdate"))
    return claims.contradictions(rows, ["l_partkey", "period", "l_returnflag"], "l_quantity", "l_linestatus")
