"""Scalar text, identity, money and token functions over the document tables.

The tables hold Latin prose, so word lists are passed in as parameters; the Korean defaults
are covered by the unit tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import identity, money
from tracewell.functions import patterns as P
from tracewell.functions import spans, text
from tracewell.operators.fields import aspect_fit, flatten_metadata, json_object, scale_finding, splice_patch
from tracewell.plans.registry import Tables, query

STOP = ["the", "and", "of", "les", "der", "que"]
PARTICLES = ["tion", "ent", "er", "on", "s"]
DICTIONARY = {"the": ["thesis", "theme"], "tion": ["motion", "theme"], "qu": ["quest", "motion"]}
MARKERS_A, MARKERS_B = ["tion", "ment"], ["the", "que"]

# SQL fragments shared by the oracle statements.
WS = P.WS
TAILS = "|".join(sorted(PARTICLES, key=len, reverse=True))
STOP_SQL = ", ".join(f"'{s}'" for s in STOP)


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_norm(x: str) -> str:
    return sql_clean(f"replace(lower({x}), 'ㆍ', ' ')")


def sql_words(x: str) -> str:
    return f"regexp_extract_all({sql_norm(x)}, '{P.WORD}')"


def sql_double(x: str) -> str:
    """Double every character: one copy closes a match, the other opens the next one.

    This stands in for the look-around that RE2 does not have.
    """
    return f"regexp_replace({x}, '(.)', '\\1\\1', 'gs')"


def sql_undouble(x: str) -> str:
    return f"regexp_replace({x}, '(?s)(.).', '\\1', 'g')"


def sql_numbers(x: str) -> str:
    number = (r"(?:^|[^A-Za-z0-9_])((?:[+-][+-])?(?:\p{Nd}\p{Nd})(?:[\p{Nd},][\p{Nd},])*(?:\.\.(?:\p{Nd}\p{Nd})+)?(?:%%)?)"
              r"(?:$|[^A-Za-z0-9_])")
    return (f"list_transform(regexp_extract_all({sql_double(x)}, '{number}', 1), "
            f"lambda x: replace({sql_undouble('x')}, ',', ''))")


def sql_years(x: str) -> str:
    year = r"(?:^|[^\p{Nd}])((?:1199|2200)\p{Nd}{4})(?:$|[^\p{Nd}])"
    return f"list_transform(regexp_extract_all({sql_double(x)}, '{year}', 1), lambda x: {sql_undouble('x')})"


def sql_terms(x: str) -> str:
    return (f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '{P.TERM}'), lambda x: "
            f"regexp_replace(lower(x), '^(.{{2,}}?)(?:{TAILS})$', '\\1')), lambda x: x NOT IN ({STOP_SQL})))")


def sql_claims(x: str) -> str:
    guard = r"'(\p{Nd})\.(\p{Nd})', '\1' || chr(65534) || '\2', 'g'"
    return (f"list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace({x}, {guard}), {guard}), "
            f"'[^.!?\\n]*[.!?]+|[^.!?\\n]+'), lambda x: replace(x, chr(65534), '.')), lambda x: {sql_strip('x')} <> '')")


@query("clean_text", f"""
SELECT doc_id, sha256({sql_clean('text')}) AS clean_sha, sha256({sql_norm('text')}) AS norm_sha,
       length({sql_clean('text')}) AS n_clean
FROM documents""")
def clean_text(t: Tables):
    d = t.spread("documents").select("doc_id", text.clean(F.col("text")).alias("c"), text.lexical_normalize(F.col("text")).alias("n"))
    return d.select("doc_id", F.sha2("c", 256).alias("clean_sha"), F.sha2("n", 256).alias("norm_sha"),
                    F.length("c").alias("n_clean"))


@query("dedupe_consecutive", f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_clean('x')}),
                                      lambda x: x <> '') AS a FROM documents),
k AS (SELECT doc_id, a, list_filter(a, lambda x, i: i = 1 OR a[i - 1] <> x) AS b FROM l)
SELECT doc_id, len(a) AS n_lines, len(b) AS n_kept, sha256(array_to_string(b, chr(10))) AS kept_sha FROM k""")
def dedupe_consecutive(t: Tables):
    d = t.spread("documents").select("doc_id", text.clean_lines(F.col("text")).alias("a"))
    d = d.withColumn("b", text.consecutive_distinct(F.col("a")))
    return d.select("doc_id", F.size("a").alias("n_lines"), F.size("b").alias("n_kept"),
                    F.sha2(F.array_join("b", "\n"), 256).alias("kept_sha"))


@query("global_ids", """
SELECT doc_id,
  'GCH_' || substr(sha256(lang || chr(31) || source || chr(31) || doc_id || chr(31) || 'CH_TEXT_00001' || chr(31)), 1, 32) AS level0_id,
  'GCH_' || substr(sha256(lang || chr(31) || source || chr(31) || doc_id || chr(31) || 'CH_TEXT_00001' || chr(31) || '2'), 1, 32) AS level2_id,
  'GCH_' || sha256(lang || chr(31) || source || chr(31) || doc_id || chr(31) || 'CH_POC_00001' || chr(31) || '0') AS upload_id,
  substr(sha256(source), 1, 20) AS segment
FROM documents""")
def global_ids(t: Tables):
    key = [F.col("lang"), F.col("source"), F.col("doc_id").cast("string")]
    return t.documents.select(
        "doc_id",
        identity.global_chunk_id(*key, "CH_TEXT_00001", 0).alias("level0_id"),
        identity.global_chunk_id(*key, "CH_TEXT_00001", 2).alias("level2_id"),
        identity.upload_chunk_id(*key, F.lit("CH_POC_00001")).alias("upload_id"),
        identity.safe_segment(F.col("source")).alias("segment"))


@query("evidence_ids", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  'CR_' || substr(sha256(l_returnflag || chr(31) || coalesce(nullif(l_orderkey, 0)::VARCHAR, '') || chr(31) || coalesce(nullif(l_partkey, 0)::VARCHAR, '')), 1, 20) AS credit_id,
  'ATT_' || substr(sha256(l_linestatus || chr(31) || coalesce(nullif(l_suppkey, 0)::VARCHAR, '') || chr(31)), 1, 20) AS attachment_id,
  'ATT_' || substr(sha256(l_linestatus || chr(31) || CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_linenumber - 1 AS VARCHAR) END || chr(31) || CASE WHEN l_quantity > 25 THEN 'True' ELSE '' END), 1, 20) AS falsy_id
FROM lineitem""")
def evidence_ids(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        identity.evidence_id("CR", F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_partkey")).alias("credit_id"),
        identity.evidence_id("ATT", F.col("l_linestatus"), F.col("l_suppkey"), F.lit(None)).alias("attachment_id"),
        identity.evidence_id("ATT", F.col("l_linestatus"), F.col("l_linenumber") - 1, F.col("l_quantity") > 25).alias("falsy_id"))


@query("content_type", r"""
WITH w AS (SELECT unnest(string_split(text, ' ')) AS v FROM documents), c AS (SELECT regexp_replace(v, '[, ]', '', 'g') AS v FROM w)
SELECT CASE WHEN v = '' THEN 'empty' WHEN v IN ('-', '–', '—', 'N/A', 'n/a') THEN 'missing'
            WHEN regexp_full_match(v, '[+-]?(?:\p{Nd}+(?:\.\p{Nd}+)?|\.\p{Nd}+)%?') THEN 'number' ELSE 'text' END AS content_type,
       count(*) AS cells FROM c GROUP BY 1""")
def content_type(t: Tables):
    words = t.spread("documents").select(F.explode_outer(F.split("text", " ")).alias("v")).where("v IS NOT NULL")
    return words.groupBy(text.content_type(F.col("v")).alias("content_type")).agg(F.count(F.lit(1)).alias("cells"))


@query("chunk_metadata", f"""
WITH c AS (SELECT doc_id, 'CH_TEXT_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS chunk_id, {sql_clean('text')} AS body,
                  lang || chr(10) || {sql_clean('text')} AS active FROM documents)
SELECT chunk_id AS canonical_chunk_id, chunk_id || ':L1' AS variant_id, sha256(body) AS canonical_embedding_sha256,
       length(body) AS canonical_embedding_chars, length(active) AS active_embedding_chars,
       'experimental_representation' AS embedding_profile FROM c""")
def chunk_metadata(t: Tables):
    from tracewell.operators.chunks import chunk_metadata as describe

    body = text.clean(F.col("text"))
    d = t.documents.select(
        F.concat(F.lit("CH_TEXT_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("chunk_id"),
        body.alias("body"), F.concat_ws("\n", "lang", body).alias("active"))
    return describe(d, "chunk_id", F.col("body"), F.col("active"), level=1)


@query("mask_numbers", f"""
WITH d AS (SELECT doc_id, replace(replace(text, 'tion', 'TARGET'), 'on', 'TARGET') AS x FROM documents),
n AS (SELECT doc_id, {sql_double('x')} AS y FROM d),
y AS (SELECT doc_id, regexp_replace(y, '(^|[^\\p{{Nd}}])(?:1199|2200)\\p{{Nd}}{{4}}[./-]{{2}}(?:\\p{{Nd}}\\p{{Nd}}){{1,2}}[./-]{{2}}(?:\\p{{Nd}}\\p{{Nd}}){{1,2}}($|[^\\p{{Nd}}])', '\\1DDAATTEE\\2', 'g') AS y FROM n),
m AS (SELECT doc_id, regexp_replace(y, '(^|[^A-Za-z0-9_])(?:[+-][+-])?\\p{{Nd}}\\p{{Nd}}(?:[\\p{{Nd}},][\\p{{Nd}},])*(?:\\.\\.(?:\\p{{Nd}}\\p{{Nd}})+)?(?:%%)?($|[^A-Za-z0-9_])', '\\1NNUUMM\\2', 'g') AS y FROM y)
SELECT doc_id, sha256({sql_undouble('y')}) AS masked_sha FROM m""")
def mask_numbers(t: Tables):
    masked = text.mask_style(F.col("text"), ["on", "tion"], target="TARGET", company="COMPANY", day="DATE",
                             period="PERIOD", value="NUM")
    return t.spread("documents").select("doc_id", F.sha2(masked, 256).alias("masked_sha"))


CITED = ("text || ' [ATT_' || substr(sha256(lang), 1, 20) || '] x , y [cr_' || substr(sha256(source), 1, 20) || '] ATT_' "
         "|| substr(sha256(lang), 1, 20)")


def _cited():
    return F.concat(
        F.col("text"), F.lit(" [ATT_"), F.substring(F.sha2("lang", 256), 1, 20), F.lit("] x , y [cr_"),
        F.substring(F.sha2("source", 256), 1, 20), F.lit("] ATT_"), F.substring(F.sha2("lang", 256), 1, 20))


@query("strip_citations", f"""
WITH d AS (SELECT doc_id, {CITED} AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(x, '(?i)\\[?{WS}*(?:CR|ATT)_[a-f0-9]{{20}}{WS}*\\]?', '', 'g') AS x FROM d),
b AS (SELECT doc_id, regexp_replace(x, '{WS}+([.,;:])', '\\1', 'g') AS x FROM a)
SELECT doc_id, sha256({sql_strip("regexp_replace(x, '[ \\t]{2,}', ' ', 'g')")}) AS visible_sha FROM b""")
def strip_citations(t: Tables):
    return t.spread("documents").select("doc_id", F.sha2(text.visible_text(_cited()), 256).alias("visible_sha"))


@query("cited_ids", f"""
WITH d AS (SELECT doc_id, lang, regexp_extract_all({CITED}, '{P.CITATION}') AS c FROM documents)
SELECT doc_id, len(list_distinct(c)) AS n_cited, c[1] AS first_cited,
       list_contains(c, 'ATT_' || substr(sha256(lang), 1, 20)) AS allowed FROM d""")
def cited_ids(t: Tables):
    d = t.documents.select("doc_id", "lang", text.citations(_cited()).alias("c"))
    allowed = F.array(F.concat(F.lit("ATT_"), F.substring(F.sha2("lang", 256), 1, 20)))
    return d.select("doc_id", F.size("c").alias("n_cited"), F.get("c", 0).alias("first_cited"),
                    (F.size(F.array_intersect("c", allowed)) > 0).alias("allowed"))


@query("looks_complete", f"""
SELECT turn, role, conv_id, regexp_matches({sql_clean("regexp_replace(text, '" + P.CITATION + "', '', 'g')")}, '(?:[.!?。]|en|s)$') AS complete
FROM conversations""")
def looks_complete(t: Tables):
    return t.conversations.select("conv_id", "turn", "role", text.looks_complete(F.col("text"), ["en", "s"]).alias("complete"))


@query("rollback_tail", f"""
WITH d AS (SELECT doc_id, {sql_strip("text || ' [ATT_' || substr(sha256(lang), 1, 20) || '] unfinished'")} AS x FROM documents),
p AS (SELECT doc_id, x, regexp_extract(x, '(?is)^(.*[.!?。](?:{WS}*\\[(?:CR|ATT)_[a-f0-9]{{20}}\\])*)[^.!?。]*$', 1) AS cut FROM d)
SELECT doc_id, sha256(CASE WHEN regexp_matches(x, '[.!?。]') THEN regexp_replace(cut, '{WS}+$', '') ELSE x END) AS tail_sha FROM p
""")
def rollback_tail(t: Tables):
    # The start of these texts never begins with white space once stripped; only the end matters.
    unfinished = text.strip(F.concat(F.col("text"), F.lit(" [ATT_"), F.substring(F.sha2("lang", 256), 1, 20), F.lit("] unfinished")))
    return t.spread("documents").select("doc_id", F.sha2(text.rollback_tail(unfinished), 256).alias("tail_sha"))


@query("overlap_merge", f"""
WITH d AS (SELECT doc_id, text AS base, {sql_strip("substr(text, greatest(length(text) - 59, 1), 60) || ' tail ' || source")} AS v FROM documents),
s AS (SELECT doc_id, base, v, max(n) FILTER (WHERE n <= least(240, length(base), length(v)) AND right(base, n) = left(v, n)) AS n
      FROM d, range(13, 241) r(n) GROUP BY ALL)
SELECT doc_id, CASE WHEN starts_with(v, base) THEN ltrim(substr(v, length(base) + 1))
                    WHEN n IS NOT NULL THEN ltrim(substr(v, n + 1)) ELSE v END AS addition FROM s""")
def overlap_merge(t: Tables):
    tail = F.concat(F.substring(F.col("text"), F.greatest(F.length("text") - 59, F.lit(1)), F.lit(60)), F.lit(" tail "), F.col("source"))
    return t.spread("documents").select("doc_id", text.novel_continuation(F.col("text"), tail).alias("addition"))


@query("lexical_tokens", f"""
WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
b AS (SELECT doc_id, w, flatten(list_transform(list_filter(w, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^\\p{{Nd}}')),
        lambda x: list_transform(range(1, length(x)), lambda i: 'c2:' || substr(x, i, 2)))) AS b FROM w)
SELECT doc_id, len(w) AS n_words, len(b) AS n_bigrams, sha256(array_to_string(list_concat(w, b), ' ')) AS token_sha FROM b""")
def lexical_tokens(t: Tables):
    d = t.spread("documents").select("doc_id", text.lexical_words(F.col("text")).alias("w"), text.bigrams(F.col("text")).alias("b"))
    return d.select("doc_id", F.size("w").alias("n_words"), F.size("b").alias("n_bigrams"),
                    F.sha2(F.array_join(F.concat("w", "b"), " "), 256).alias("token_sha"))


@query("query_expand", """
WITH d AS (SELECT item_id, text, list_concat(
   CASE WHEN contains(text, 'the') THEN ['thesis', 'theme'] ELSE [] END,
   CASE WHEN contains(text, 'tion') AND contains(text, 'the') THEN ['motion'] WHEN contains(text, 'tion') THEN ['motion', 'theme'] ELSE [] END,
   CASE WHEN contains(text, 'qu') AND contains(text, 'tion') THEN ['quest'] WHEN contains(text, 'qu') THEN ['quest', 'motion'] ELSE [] END) AS a FROM benchmark)
SELECT item_id, CASE WHEN len(a) = 0 THEN text ELSE text || chr(10) || 'concepts: ' || array_to_string(a, ', ') END AS expanded FROM d""")
def query_expand(t: Tables):
    return t.benchmark.select("item_id", text.expand_query(F.col("text"), DICTIONARY, "\nconcepts: ").alias("expanded"))


@query("terms", f"""
WITH d AS (SELECT doc_id, list_sort({sql_terms('text')}) AS a FROM documents)
SELECT doc_id, len(a) AS n_terms, sha256(array_to_string(a, ' ')) AS terms_sha FROM d""")
def terms(t: Tables):
    d = t.spread("documents").select("doc_id", F.array_sort(text.terms(F.col("text"), STOP, PARTICLES)).alias("a"))
    return d.select("doc_id", F.size("a").alias("n_terms"), F.sha2(F.array_join("a", " "), 256).alias("terms_sha"))


@query("sentences_naive", f"""
WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]+|$)|\\n+'),
     lambda x: {sql_strip('x')}), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, len(a) AS n_sentences, sha256(array_to_string(a, '|')) AS sentence_sha FROM d""")
def sentences_naive(t: Tables):
    d = t.spread("documents").select("doc_id", text.sentences_naive(F.col("text")).alias("a"))
    return d.select("doc_id", F.size("a").alias("n_sentences"), F.sha2(F.array_join("a", "|"), 256).alias("sentence_sha"))


@query("claim_segment", f"""
WITH d AS (SELECT doc_id, {sql_claims('text')} AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS claim, generate_subscripts(a, 1) AS n FROM d)
SELECT doc_id, 'A-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS claim_id,
       sha256(claim) AS claim_sha, length(claim) AS claim_chars FROM e""")
def claim_segment(t: Tables):
    from tracewell.operators.claims import segment_claims

    c = segment_claims(t.spread("documents", "doc_id", "text").select("doc_id", F.lit("A").alias("item"), "text"), "doc_id")
    return c.select("doc_id", "claim_id", F.sha2("claim", 256).alias("claim_sha"), (F.col("stop") - F.col("start")).alias("claim_chars"))


@query("anchor", """
WITH d AS (SELECT doc_id, text, regexp_extract(text, 'on') AS n FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(CASE WHEN n <> '' THEN string_split(text, 'on')[1] ELSE text END, '""" + P.TERM + """'),
      lambda x: lower(x)), lambda x: x NOT IN ('the', 'and', 'of', 'les', 'der', 'que')) AS a FROM d)
SELECT doc_id, array_to_string(a[greatest(len(a) - 3, 1):len(a)], ' ') AS anchor FROM p""")
def anchor(t: Tables):
    return t.documents.select("doc_id", F.array_join(text.anchor(F.col("text"), F.lit("on"), STOP), " ").alias("anchor"))


@query("content_hash", f"""
SELECT doc_id, sha256({sql_clean('lower(text)')}) AS content_hash FROM documents""")
def content_hash(t: Tables):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("chat_intent", f"""
WITH d AS (SELECT conv_id, turn, role, {sql_clean('lower(text)')} AS x FROM conversations)
SELECT conv_id, turn, role, CASE WHEN contains(x, 'tion') OR contains(x, 'ment') THEN 'OPINION_QA'
   WHEN contains(x, 'the') OR contains(x, 'que') THEN 'CASE_QA' ELSE 'GENERAL' END AS intent FROM d""")
def chat_intent(t: Tables):
    return t.conversations.select("conv_id", "turn", "role", text.chat_intent(F.col("text"), MARKERS_A, MARKERS_B).alias("intent"))


@query("query_profiles", "WITH p(review_item, title, terms) AS (VALUES "
       + ", ".join(f"('{i}', '{P.ITEM_TITLES[i]}', '{', '.join(P.ITEM_PROFILE_TERMS[i])}')" for i in P.REVIEW_ITEMS) + """)
SELECT c_custkey, review_item, title || chr(10) || '여신유형 ' || c_mktsegment || chr(10) || '산업분류 ' || c_nationkey || chr(10)
  || '대상기업 ' || c_name || chr(10) || '검색개념 ' || terms AS profile FROM customer, p""")
def query_profiles(t: Tables):
    from tracewell.operators.profiles import query_profiles as profiles

    return profiles(t.customer, loan=F.col("c_mktsegment"), industry=F.col("c_nationkey"), company=F.col("c_name")).select(
        "c_custkey", "review_item", "profile")


@query("prompt_blocks", """
SELECT item_id, '[근거 ' || (item_id + 1) || ']' || chr(10) || 'evidence_id=Q1-L0-R' || (item_id + 1) || chr(10)
  || 'global_chunk_id=' || item_id || chr(10) || 'local_chunk_id=' || item_id || chr(10) || 'document_id=' || item_id || chr(10)
  || 'source_filename=bench' || chr(10) || 'source_pages=[]' || chr(10) || 'content:' || chr(10) || text || chr(10) AS block
FROM benchmark""")
def prompt_blocks(t: Tables):
    from tracewell.operators.prompts import evidence_block

    key = F.col("item_id").cast("string")
    return t.benchmark.select("item_id", evidence_block(
        query_id=F.lit("Q1"), level=F.lit(0), rank=F.col("item_id") + 1, global_id=key, local_id=key, document_id=key,
        filename=F.lit("bench"), pages=F.lit("[]"), content=F.col("text")).alias("block"))


@query("money_normalize", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS v,
   CASE l_returnflag WHEN 'A' THEN '만원' WHEN 'N' THEN '천원' WHEN 'R' THEN '억원' ELSE 'EA' END AS u FROM lineitem),
r AS (SELECT *, CASE u WHEN '만원' THEN round(v * 0.01, 1) WHEN '천원' THEN round(v * 0.001, 1) WHEN '억원' THEN round(v * 100.0, 1) END AS x FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(v AS VARCHAR) AS raw_value,
  CASE WHEN x IS NULL THEN CAST(v AS VARCHAR) WHEN x = floor(x) THEN format('{:,}', CAST(x AS BIGINT))
       ELSE format('{:,}', CAST(floor(x) AS BIGINT)) || '.' || CAST(CAST(round((x - floor(x)) * 10) AS INTEGER) AS VARCHAR) END AS text,
  CASE WHEN x IS NULL THEN u ELSE '백만원' END AS unit, x IS NOT NULL AS normalized FROM r""")
def money_normalize(t: Tables):
    value = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    unit = F.when(F.col("l_returnflag") == "A", "만원").when(F.col("l_returnflag") == "N", "천원").when(
        F.col("l_returnflag") == "R", "억원").otherwise("EA")
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("raw_value"), unit.alias("u"))
    d = d.withColumn("m", money.normalize_money(F.col("raw_value"), F.col("u")))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "raw_value", "m.text", "m.unit", "m.normalized")


@query("canonical_number", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 25 THEN '-' ELSE '+' END || format('{:,.2f}', abs(l_extendedprice * (l_quantity - 25))) AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, raw,
  CASE WHEN c IN ('-0', '') THEN '0' ELSE c END AS canonical FROM (
  SELECT *, regexp_replace(regexp_replace(replace(replace(raw, ',', ''), '+', ''), '0+$', ''), '\\.$', '') AS c FROM m)""")
def canonical_number(t: Tables):
    amount = F.col("l_extendedprice") * (F.col("l_quantity") - 25)
    raw = F.concat(F.when(amount < 0, "").otherwise("+"), F.format_number(amount, 2))
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return d.withColumn("canonical", text.canonical_number(F.col("raw")))


@query("token_estimate", """
SELECT conv_id, count(*) AS messages, CAST(sum(greatest(1, ceil(length(text) / 1.7)) + 8) AS BIGINT) + 8 AS prompt_tokens,
       greatest(0, 23172 - (CAST(sum(greatest(1, ceil(length(text) / 1.7)) + 8) AS BIGINT) + 8)) AS remaining_tokens
FROM conversations GROUP BY conv_id""")
def token_estimate(t: Tables):
    from tracewell.operators.prompts import TokenBudget, budget_snapshot

    return budget_snapshot(t.conversations, ["conv_id"], F.col("text"), TokenBudget()).select(
        "conv_id", "messages", "prompt_tokens", "remaining_tokens")


@query("periods", f"""
WITH d AS (SELECT doc_id, list_sort(list_distinct({sql_years('text')})) AS y FROM documents)
SELECT doc_id, len(y) AS n_years, array_to_string(y, ',') AS years FROM d""")
def periods(t: Tables):
    return t.documents.select("doc_id", text.years(F.col("text")).alias("y")).select(
        "doc_id", F.size("y").alias("n_years"), F.array_join("y", ",").alias("years"))


@query("numeric_lexemes", f"""
WITH d AS (SELECT doc_id, list_sort(list_distinct({sql_numbers("regexp_replace(text, '(^|[^\\p{L}\\p{N}_])[A-Z]{1,3}\\p{Nd}{1,7}=', '\\1=', 'g')")})) AS n FROM documents)
SELECT doc_id, len(n) AS n_numbers, array_to_string(n, ' ') AS numbers FROM d""")
def numeric_lexemes(t: Tables):
    return t.documents.select("doc_id", F.array_sort(text.numeric_lexemes(F.col("text"))).alias("n")).select(
        "doc_id", F.size("n").alias("n_numbers"), F.array_join("n", " ").alias("numbers"))


@query("dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS canonical, 'date' AS kind, strftime(o_orderdate, '%Y') AS period FROM orders""")
def dates(t: Tables):
    d = t.orders.select("o_orderkey", F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" due")).alias("s"))
    d = spans.exploded_numbers(d, "s", "o_orderkey").where("n.kind = 'date'")
    return d.select("o_orderkey", "n.canonical", "n.kind", F.array_join("n.periods", ",").alias("period"))


@query("numeric_tokens", """
SELECT l_orderkey, l_linenumber, l_partkey, kind, canonical, unit, strftime(l_shipdate, '%Y') AS periods FROM (
 SELECT *, unnest([
   {'kind': 'period', 'canonical': strftime(l_shipdate, '%Y-%m'), 'unit': '월'},
   {'kind': 'percent', 'canonical': CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR), 'unit': '%'},
   {'kind': 'number', 'canonical': CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 'unit': '백만원'}], recursive := true) FROM lineitem)""")
def numeric_tokens(t: Tables):
    sentence = F.concat(
        F.date_format("l_shipdate", "yyyy'년 'M'월'"), F.lit(" rate "), F.round(F.col("l_discount") * 100).cast("int").cast("string"),
        F.lit("% page 3, amount "), F.col("l_quantity").cast("int").cast("string"), F.lit("백만원 B12=7"))
    d = spans.exploded_numbers(t.spread("lineitem"), sentence, "l_orderkey", "l_linenumber", "l_partkey")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "n.kind", "n.canonical", "n.unit", F.array_join("n.periods", ",").alias("periods"))


@query("markdown_rows", """
SELECT p_partkey, '| ' || replace(replace(p_name, ' ', '|'), '|', '\\|') || ' | ' || p_brand || ' | ' || p_size || ' |' AS markdown FROM part""")
def markdown_rows(t: Tables):
    from tracewell.operators.chunks import markdown_row

    return t.part.select("p_partkey", markdown_row(F.array(F.replace("p_name", F.lit(" "), F.lit("|")), "p_brand", F.col("p_size").cast("string"))).alias("markdown"))


@query("array_distinct", f"""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i FROM e GROUP BY ALL)
SELECT doc_id, count(*) AS n_distinct, sha256(string_agg(x, ' ' ORDER BY i)) AS ordered_sha FROM f GROUP BY doc_id""")
def array_distinct(t: Tables):
    d = t.documents.select("doc_id", F.array_distinct(F.split("text", " ")).alias("a"))
    return d.select("doc_id", F.size("a").alias("n_distinct"), F.sha2(F.array_join("a", " "), 256).alias("ordered_sha"))


@query("json_props", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'PARSED' AS status FROM events""")
def json_props(t: Tables):
    noisy = F.concat(F.lit("reply: ``` "), F.col("props"), F.lit(" ``` end"))
    d = t.events.select("event_id", json_object(noisy, "k bigint").alias("j"))
    return d.select("event_id", "j.k", F.when(F.col("j").isNull(), "WARN").otherwise("PARSED").alias("status"))


@query("metadata_flatten", """
SELECT vec_id, to_json(map_from_entries(list_filter([{'k': 'label', 'v': CAST(label AS VARCHAR)}, {'k': 'dims', 'v': CAST(len(embedding) AS VARCHAR)},
   {'k': 'note', 'v': CASE WHEN label > 4 THEN 'high' END}], lambda e: e.v IS NOT NULL))) AS metadata FROM embeddings""")
def metadata_flatten(t: Tables):
    return t.embeddings.select("vec_id", flatten_metadata({
        "label": F.col("label"), "dims": F.size("embedding"), "note": F.when(F.col("label") > 4, "high")}).alias("metadata"))


@query("finding_ladder", """
WITH f AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'PASS' WHEN 'view' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'signup' THEN 'FAIL' ELSE 'odd' END AS status,
  CASE WHEN value > 40 THEN 'CLAIM_ERROR' ELSE 'MINOR' END AS severity, CASE WHEN user_id % 3 = 0 THEN 'STYLE' ELSE 'UNIT_MISMATCH' END AS reason_code,
  CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type END AS span, 'an ' || event_type AS claim, user_id % 7 AS n_rows, user_id % 4 AS n_ids FROM events)
SELECT event_id, CASE WHEN status = 'odd' THEN 'WARN' WHEN status <> 'FAIL' THEN status WHEN n_rows = 0 THEN 'INSUFFICIENT_EVIDENCE'
   WHEN reason_code = 'STYLE' OR severity <> 'MINOR' OR span = '' THEN 'WARN' WHEN n_ids = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'FAIL' END AS status,
 CASE WHEN status = 'odd' THEN 'VERIFIER_SCHEMA_ERROR' WHEN status <> 'FAIL' THEN reason_code WHEN n_rows = 0 THEN 'NO_EVIDENCE' WHEN reason_code = 'STYLE' THEN 'UNSAFE_FAIL_REASON'
   WHEN severity <> 'MINOR' THEN 'AUTO_PATCH_SCOPE_TOO_WIDE' WHEN span = '' THEN 'INVALID_FAIL_SPAN' WHEN n_ids = 0 THEN 'UNBOUND_FAIL_EVIDENCE' ELSE reason_code END AS reason_code
FROM f""")
def finding_ladder(t: Tables):
    kind = F.col("event_type")
    d = t.events.select(
        "event_id",
        F.when(kind == "error", "fail").when(kind == "click", "PASS").when(kind == "view", "INSUFFICIENT_EVIDENCE").when(kind == "signup", "FAIL").otherwise("odd").alias("status"),
        F.when(F.col("value") > 40, "CLAIM_ERROR").otherwise("minor").alias("severity"),
        F.when(F.col("user_id") % 3 == 0, "style").otherwise("UNIT_MISMATCH").alias("reason_code"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(kind).alias("span"), F.concat(F.lit("an "), kind).alias("claim"),
        (F.col("user_id") % 7).alias("n_rows"), (F.col("user_id") % 4).alias("n_ids"))
    return d.select("event_id", scale_finding(F.col("status"), F.col("severity"), F.col("reason_code"), F.col("span"), F.col("claim"),
                                              F.col("n_rows"), F.col("n_ids")).alias("f")).select("event_id", "f.status", "f.reason_code")


@query("patch_guard", """
WITH p AS (SELECT o_orderkey, 'order ' || o_orderpriority || ' is ' || o_orderstatus || ' and ' || o_orderstatus AS claim,
   CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 = 1 THEN 'absent' ELSE ' ' || o_orderstatus END AS span,
   CASE WHEN o_custkey % 5 = 0 THEN repeat('x', 130) ELSE ' state' END AS patch, CASE WHEN o_custkey % 6 = 0 THEN 'CLAIM_ERROR' ELSE 'MINOR' END AS severity FROM orders)
SELECT o_orderkey, CASE WHEN severity = 'MINOR' AND span <> '' AND contains(claim, span) AND length(trim(patch)) <= greatest(120, 2 * length(span))
  THEN substr(claim, 1, instr(claim, span) - 1) || trim(patch) || substr(claim, instr(claim, span) + length(span)) END AS patched FROM p""")
def patch_guard(t: Tables):
    key = F.col("o_custkey")
    claim = F.concat(F.lit("order "), F.col("o_orderpriority"), F.lit(" is "), F.col("o_orderstatus"), F.lit(" and "), F.col("o_orderstatus"))
    span = F.when(key % 4 == 0, "").when(key % 4 == 1, "absent").otherwise(F.concat(F.lit(" "), F.col("o_orderstatus")))
    patch = F.when(key % 5 == 0, "x" * 130).otherwise(" state")
    return t.orders.select("o_orderkey", splice_patch(claim, span, patch, F.when(key % 6 == 0, "CLAIM_ERROR").otherwise("MINOR")).alias("patched"))


@query("aspect_fit", """
WITH p AS (SELECT p_partkey, 100 + p_size AS w, CAST(trunc(100 + p_retailprice) AS INTEGER) AS h FROM part),
f AS (SELECT *, 6.0 * h / w > 8.0 AS tall FROM p)
SELECT p_partkey, round(greatest(1.0, CASE WHEN tall THEN 8.0 * w / h ELSE 6.0 END), 6) AS width,
  round(greatest(1.0, CASE WHEN tall THEN 8.0 ELSE 6.0 * h / w END), 6) AS height FROM f""")
def aspect_fit_query(t: Tables):
    fit = aspect_fit(F.col("p_size") + 100, F.col("p_retailprice") + 100, 6.0, 8.0)
    return t.part.select("p_partkey", fit.alias("f")).select("p_partkey", F.round("f.width", 6).alias("width"), F.round("f.height", 6).alias("height"))


@query("cell_rows", r"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, chr(CAST(65 + l_linenumber AS INTEGER)) || l_quantity::INTEGER || ':Z99' AS cell_range FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(regexp_extract(cell_range, '(\d+)', 1) AS INTEGER) AS row_no,
       (CAST(regexp_extract(cell_range, '(\d+)', 1) AS INTEGER) - 1) // 12 AS band FROM c""")
def cell_rows(t: Tables):
    from tracewell.operators.grouping import first_row, row_band

    cell = F.concat(F.char(F.lit(65) + F.col("l_linenumber")), F.col("l_quantity").cast("int").cast("string"), F.lit(":Z99"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", first_row(cell).alias("row_no"), row_band(cell).alias("band"))


@query("repeat_by_counts", """
SELECT o_orderkey, array_to_string(list_concat(list_transform(range(o_custkey % 3), lambda i: o_orderstatus), list_transform(range(o_custkey % 2 + 1), lambda i: o_orderpriority)), '|') AS expanded FROM orders""")
def repeat_by_counts(t: Tables):
    from tracewell.operators.fields import repeat_each

    return t.orders.select("o_orderkey", F.array_join(repeat_each(
        F.array("o_orderstatus", "o_orderpriority"), F.array((F.col("o_custkey") % 3).cast("int"), (F.col("o_custkey") % 2 + 1).cast("int"))), "|").alias("expanded"))
