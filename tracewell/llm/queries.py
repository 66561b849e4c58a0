"""The queries opN over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.llm import (anchor_simhash, attention_lm, bpe_count, fm_decontaminate, hyperplane_tree, lang_bits, line_rules, maxplus_pieces, norm_buckets,
                           pivotal_grams, secret_guess, warc_chain, wrappers)
from tracewell.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def sql(text: str):
    """The SQL of the query below; the others have models, fingerprints or tokenizers that SQL lacks."""
    def held(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLES[build.__name__] = text
        return build

    return held


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_ITEM_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secret_guess.scan(docs, secret_guess.learned(docs))


@query
def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return attention_lm.score(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op3_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(table(spark, folder, "documents"))


@query
def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return maxplus_pieces.report(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@sql(f"""
WITH d AS (SELECT doc_id, {SQL_ITEM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_ITEM_WORDS} AS w FROM benchmark),
s AS (SELECT item, w, least(len(w), 13) AS size, unnest(range(0, greatest(len(w) - 12, 1))) AS k FROM i WHERE len(w) > 0),
x AS (SELECT DISTINCT item, size, array_to_string(w[k + 1:k + size], ' ') AS key FROM s),
p AS (SELECT doc_id, size, unnest(range(0, len(w) - size + 1)) AS k, w FROM d, (SELECT DISTINCT size FROM x) WHERE len(w) >= size),
h AS (SELECT doc_id, item, k, p.size FROM p JOIN x ON x.size = p.size AND x.key = array_to_string(w[k + 1:k + p.size], ' ')),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""")
@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return fm_decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.report(table(spark, folder, "pages"))


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = lang_bits.fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = docs.select("doc_id", held_out.alias("held_out"), lang_bits.predict(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return anchor_simhash.report(table(spark, folder, "documents"))


@sql(f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
v AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(sha1(html), 1 + 5 * g, 5) AS BIGINT)) AS v FROM p)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0], lambda b: '{BASE32}'[CAST(((x >> b) & 31) + 1 AS INTEGER)]))), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM v""")
@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc_chain.report(table(spark, folder, "pages"))


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Vectors that take part, as whole numbers.
SQL_VECTORS = """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
SQL_SCORE = "CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT)"


@sql(f"""
WITH e AS ({SQL_VECTORS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {SQL_SCORE} AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
@query
def op11_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return norm_buckets.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@sql(f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({SQL_VECTORS}) WHERE label IS NOT NULL),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id AS other_id, q.label = c.label AS same, {SQL_SCORE} AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hyperplane_tree.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return pivotal_grams.report(table(spark, folder, "documents"))
