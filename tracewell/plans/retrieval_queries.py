"""Lexical statistics, vectors and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.vectors import cosine, hash_counts, l2_normalize, norm
from tracewell.operators import lexical, retrieval
from tracewell.operators.clusters import Clusters
from tracewell.operators.means import mean_vectors
from tracewell.operators.postings import Postings
from tracewell.operators.scoring import best_overlap, hybrid_search, search
from tracewell.operators.topk import first_rows
from tracewell.plans.registry import Tables, query
from tracewell.plans.text_queries import PARTICLES, STOP, sql_clean, sql_terms, sql_words
from tracewell.session import shared_folder

AMOUNT_MARKERS = ["that", "when"]
UNIT_MARKER = "tion"


def sql_tokens(name: str, table: str, key: str, where: str = "") -> str:
    """Common table expressions ``name``(key, term): one row per token."""
    return f"""
{name}_w AS (SELECT {key}, {sql_words('text')} AS w FROM {table} {where}),
{name}_a AS (SELECT {key}, list_concat(w, flatten(list_transform(list_filter(w, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^\\p{{Nd}}')),
   lambda x: list_transform(range(1, length(x)), lambda i: 'c2:' || substr(x, i, 2))))) AS t FROM {name}_w),
{name} AS (SELECT {key}, unnest(t) AS term FROM {name}_a)"""


DOC_TOKENS = sql_tokens("dt", "documents", "doc_id")
QUERY_TOKENS = sql_tokens("qt", "benchmark", "item_id")
SQL_BM25 = f"""{DOC_TOKENS}, {QUERY_TOKENS},
dl AS (SELECT doc_id, len(t) AS dl FROM dt_a), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
qf AS (SELECT item_id, term, least(count(*), 2) AS qf FROM qt GROUP BY ALL),
hit AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9))) * qf) AS s
  FROM qf JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
bm AS (SELECT q.item_id, d.doc_id, round(coalesce(s, 0), 9) AS lexical FROM (SELECT item_id FROM benchmark) q CROSS JOIN (SELECT doc_id FROM documents) d
  LEFT JOIN hit h ON h.item_id = q.item_id AND h.doc_id = d.doc_id)"""


def sql_counts(name: str, table: str, key: str) -> str:
    return f"""
{name}_c AS (SELECT {key}, string_split(text, '') AS c FROM {table}),
{name}_e AS (SELECT {key}, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS i FROM {name}_c),
{name} AS (SELECT {key}, (unicode(c) + i) % 8 AS b, count(*) AS n FROM {name}_e GROUP BY ALL)"""


SQL_DENSE = f"""{sql_counts('dv', 'documents', 'doc_id')}, {sql_counts('qv', 'benchmark', 'item_id')},
dn AS (SELECT doc_id, sqrt(sum(n * n)) AS dn FROM dv GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(n * n)) AS qn FROM qv GROUP BY ALL),
ds AS (SELECT item_id, doc_id, round(sum(dv.n * qv.n) / (max(dn) * max(qn)), 9) AS dense
  FROM dv JOIN qv USING (b) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL)"""


@query("term_freq", f"""
WITH {DOC_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL)
SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, max(tf) AS max_tf FROM tf GROUP BY doc_id""")
def term_freq(t: Tables):
    counts = lexical.text_counts(t.spread("documents", "doc_id", "text"), "doc_id", F.col("text"))
    summary = text.let(F.col("counts"), lambda c: F.struct(
        F.size(c).alias("n_terms"), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["tf"]).alias("n_tokens"),
        F.array_max(F.transform(c, lambda x: x["tf"])).alias("max_tf")))
    return counts.select("doc_id", F.explode_outer(F.array(summary)).alias("s")).where("s.n_terms > 0").select("doc_id", "s.*")


@query("doc_freq", f"WITH {DOC_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM dt GROUP BY term")
def doc_freq(t: Tables):
    return lexical.document_frequency(lexical.tokenized(t.spread("documents", "doc_id", "text"), "doc_id", F.col("text")))


@query("idf", f"""
WITH {DOC_TOKENS}, df AS (SELECT term, count(DISTINCT doc_id) AS df FROM dt GROUP BY term), st AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st""")
def idf(t: Tables):
    tokens = lexical.tokenized(t.spread("documents", "doc_id", "text"), "doc_id", F.col("text"))
    return lexical.inverse_frequency(tokens).withColumn("idf", F.round("idf", 6))


@query("corpus_size", f"WITH {DOC_TOKENS} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM dt_a")
def corpus_size(t: Tables):
    tokens = lexical.tokenized(t.spread("documents", "doc_id", "text"), "doc_id", F.col("text"))
    return lexical.corpus_size(tokens).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25", f"""
WITH {SQL_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lexical DESC, doc_id) AS rank FROM bm)
SELECT item_id AS query_id, rank, doc_id, round(lexical, 6) AS score FROM r WHERE rank <= 10""")
def bm25(t: Tables):
    hits = search(t.spread("documents", "doc_id", "text"), t.benchmark, k=10, by="lexical", doc=("doc_id", "text"), query=("item_id", "text"))
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("bm25_postings", f"""
WITH {SQL_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lexical DESC, doc_id) AS rank FROM bm)
SELECT item_id AS query_id, rank, doc_id, round(lexical, 6) AS score FROM r WHERE rank <= 10""")
def bm25_postings(t: Tables):
    index = Postings(t.spark, f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}").build(t.spread("documents", "doc_id", "text"), "doc_id", "text")
    hits = index.search(t.benchmark, 10, "item_id")
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("hash_encode", f"""
WITH {sql_counts('dv', 'documents', 'doc_id')}
SELECT g_id AS doc_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY k) AS counts
FROM (SELECT doc_id AS g_id, k FROM documents, range(8) r(k)) g LEFT JOIN dv ON dv.doc_id = g_id AND dv.b = k GROUP BY g_id""")
def hash_encode(t: Tables):
    d = t.spread("documents", "doc_id", "text").select("doc_id", hash_counts("text").alias("v"))
    return d.select("doc_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("counts"))


@query("normalize", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
SELECT vec_id, round(n, 6) AS norm, round(v[1] / greatest(n, 1e-12), 6) AS first, round(list_max(v) / greatest(n, 1e-12), 6) AS largest FROM n""")
def normalize(t: Tables):
    d = t.embeddings.select("vec_id", norm(F.col("embedding")).alias("n"), l2_normalize(F.col("embedding")).alias("u"))
    return d.select("vec_id", F.round("n", 6).alias("norm"), F.round(F.get("u", 0), 6).alias("first"), F.round(F.array_max("u"), 6).alias("largest"))


@query("centroids", """
WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY ALL)
SELECT label, dim, round(m, 6) AS mean, round(m / greatest(n, 1e-12), 6) AS unit FROM m JOIN n USING (label)""")
def centroids(t: Tables):
    c = mean_vectors(t.embeddings, "label", "embedding")
    return c.select("label", F.posexplode(F.arrays_zip("mean", "unit")).alias("dim", "z")).select(
        "label", "dim", F.round("z.mean", 6).alias("mean"), F.round("z.unit", 6).alias("unit"))


SQL_LABEL_QUERY = "q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qe FROM embeddings GROUP BY label)"


@query("cosine_topk", f"""
WITH {SQL_LABEL_QUERY}, s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 9) AS s FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 5""")
def cosine_topk(t: Tables):
    chosen = first_rows(t.embeddings.select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    hits = search(t.embeddings, chosen, k=5, by="dense", doc=("vec_id", "embedding"), query=("label", "embedding"))
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("cosine_clusters", f"""
WITH {SQL_LABEL_QUERY}, s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 9) AS s FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 5""")
def cosine_clusters(t: Tables):
    chosen = first_rows(t.embeddings.select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    index = Clusters(t.spark, f"{shared_folder(t.spark)}/clusters-{uuid.uuid4().hex}").build(t.embeddings, "vec_id", "embedding")
    hits = index.search(chosen, 5, "label", "embedding")
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("dot_pairs", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT label, arg_min(v, vec_id) AS q FROM e GROUP BY label)
SELECT vec_id, round(list_dot_product(v, q), 6) AS dot, round(list_cosine_similarity(v, q), 6) AS cosine FROM e JOIN f USING (label)""")
def dot_pairs(t: Tables):
    from tracewell.functions.vectors import dot

    chosen = first_rows(t.embeddings.select("label", "vec_id", F.col("embedding").alias("q")), ["label"], ["vec_id"]).drop("vec_id")
    pairs = t.embeddings.join(chosen, "label")
    return pairs.select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("dot"),
                        F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


def _encoded(t: Tables):
    docs = t.spread("documents").withColumn("vector", hash_counts("text"))
    return docs, t.benchmark.withColumn("vector", hash_counts("text"))


@query("multi_query_topk", f"""
WITH {SQL_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS rank FROM ds)
SELECT item_id AS query_id, rank, doc_id, round(dense, 6) AS score FROM r WHERE rank <= 8""")
def multi_query_topk(t: Tables):
    docs, queries = _encoded(t)
    hits = search(docs, queries, k=8, by="dense", doc=("doc_id", "vector"), query=("item_id", "vector"))
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def sql_fused(eligible: str, boost: str) -> str:
    return f"""
WITH {SQL_DENSE}, {SQL_BM25},
p AS (SELECT item_id, doc_id, dense, lexical, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS dense_rank,
   row_number() OVER (PARTITION BY item_id ORDER BY lexical DESC, doc_id) AS lexical_rank
   FROM ds JOIN bm USING (item_id, doc_id) JOIN documents USING (doc_id) {eligible}),
f AS (SELECT p.item_id, doc_id, dense, lexical, dense_rank, lexical_rank, 1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + lexical_rank){boost} AS score
   FROM p JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = p.item_id WHERE dense_rank <= 50 OR lexical_rank <= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, dense DESC, doc_id) AS rank FROM f)
SELECT item_id AS query_id, rank, doc_id, round(score, 9) AS score, round(dense, 6) AS dense_score, round(lexical, 6) AS lexical_score, dense_rank, lexical_rank
FROM r WHERE rank <= 5"""


def _fused(hits):
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"),
                       F.round("dense_score", 6).alias("dense_score"), F.round("lexical_score", 6).alias("lexical_score"),
                       "dense_rank", "lexical_rank")


@query("hybrid_rrf", sql_fused("", """ + CASE WHEN contains(q.text, 'that') OR contains(q.text, 'when') THEN
   CASE WHEN d.lang = 'en' THEN 0.0015::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(d.text, 'tion') THEN 0.0007::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END"""))
def hybrid_rrf(t: Tables):
    docs, queries = _encoded(t)
    zero = F.lit(0.0)
    boost = F.when(
        text.any_marker(F.col("query_text"), AMOUNT_MARKERS),
        F.when(F.col("lang") == "en", F.lit(0.0015)).otherwise(zero)
        + F.when(F.col("text").contains(UNIT_MARKER), F.lit(0.0007)).otherwise(zero),
    ).otherwise(zero)
    return _fused(hybrid_search(docs, queries, doc=("doc_id", "text", "vector"), query=("item_id", "text", "vector"),
                                boost=boost, attributes=("lang", "text")))


@query("hybrid_scoped", sql_fused("WHERE lang IN ('fr', 'de')", ""))
def hybrid_scoped(t: Tables):
    docs, queries = _encoded(t)
    eligible = retrieval.overlap_filter({"lang": F.col("lang")}, {"lang": ["fr", "de"]})
    return _fused(hybrid_search(docs, queries, doc=("doc_id", "text", "vector"), query=("item_id", "text", "vector"), eligible=eligible))


SQL_ACCEPT = f"""
WITH {SQL_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS rank FROM ds),
o AS (SELECT item_id, doc_id, rank, dense AS score, sha256({sql_clean('lower(text)')}) AS h FROM r JOIN documents USING (doc_id) WHERE rank <= 32),
b AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM o), f AS (SELECT * FROM b WHERE score >= greatest(0.10, best - 0.12)),
u AS (SELECT *, row_number() OVER (PARTITION BY item_id, h ORDER BY rank) AS n FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS position FROM u WHERE n = 1)"""


def _overfetched(t: Tables):
    docs, queries = _encoded(t)
    hits = search(docs, queries, k=32, by="dense", doc=("doc_id", "vector"), query=("item_id", "vector"))
    held = retrieval.with_documents(hits, t.documents.select(F.col("doc_id").alias("id"), "text"))
    return held.withColumn("content_hash", text.content_hash(F.col("text"))).drop("text")


@query("retrieve_dedupe", SQL_ACCEPT + " SELECT item_id AS query_id, position, doc_id, round(score, 6) AS score FROM k WHERE position <= 8")
def retrieve_dedupe(t: Tables):
    kept = retrieval.accept_hits(_overfetched(t), k=8)
    return kept.select("query_id", "position", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("score_floor", SQL_ACCEPT + """, raw AS (SELECT item_id, count(*) AS raw_hit_count, max(score) AS best FROM o GROUP BY item_id), acc AS (SELECT item_id, count(*) AS n FROM k WHERE position <= 8 GROUP BY item_id)
SELECT item_id AS query_id, round(best, 6) AS best_score, round(greatest(0.10, best - 0.12), 6) AS score_floor, coalesce(raw_hit_count, 0) AS raw_hit_count, coalesce(n, 0) AS accepted_count,
  CASE WHEN raw_hit_count IS NULL THEN 'empty' WHEN n > 0 THEN 'accepted' ELSE 'low_relevance' END AS retrieval_quality
FROM benchmark LEFT JOIN raw USING (item_id) LEFT JOIN acc USING (item_id)""")
def score_floor(t: Tables):
    hits = _overfetched(t)
    labels = retrieval.search_quality(t.benchmark.select(F.col("item_id").alias("query_id")), hits, retrieval.accept_hits(hits, k=8))
    return labels.withColumns({"best_score": F.round("best_score", 6), "score_floor": F.round("score_floor", 6)})


@query("filter_overlap", """
SELECT doc_id FROM documents WHERE lang IN ('de', 'es') AND list_has_any([source, lang], ['src1', 'src2', 'es'])""")
def filter_overlap(t: Tables):
    keep = retrieval.overlap_filter({"lang": F.col("lang")}, {"lang": ["de", "es"], "missing": [None, "x"]})
    many = retrieval.overlap_filter_arrays(F.array("source", "lang"), ["src1", "src2", "es"])
    return t.documents.where(keep & many).select("doc_id")


@query("scoped_count", "SELECT count(*) FILTER (WHERE lang = 'en' AND source = 'src3') AS matched, count(*) AS total FROM documents")
def scoped_count(t: Tables):
    return t.documents.agg(F.count_if(retrieval.equality_filter({"lang": "en", "source": "src3"})).alias("matched"), F.count(F.lit(1)).alias("total"))


@query("set_similarity", f"""
WITH d AS (SELECT doc_id, {sql_terms('text')} AS a FROM documents), q AS (SELECT item_id, {sql_terms('text')} AS b FROM benchmark),
du AS (SELECT doc_id, len(a) AS na, unnest(a) AS t FROM d), qu AS (SELECT item_id, len(b) AS nb, unnest(b) AS t FROM q),
s AS (SELECT doc_id, item_id, count(*) AS overlap, count(*) / greatest(1.0::DOUBLE, sqrt(CAST(max(na) * max(nb) AS DOUBLE))) AS s FROM du JOIN qu USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) AS n FROM s)
SELECT doc_id, item_id, overlap, round(s, 6) AS score FROM r WHERE n = 1""")
def set_similarity(t: Tables):
    docs = t.spread("documents", "doc_id", "text").select("doc_id", text.terms(F.col("text"), STOP, PARTICLES).alias("terms"))
    items = t.benchmark.select("item_id", text.terms(F.col("text"), STOP, PARTICLES).alias("terms"))
    best = best_overlap(docs, items, doc=("doc_id", "terms"), query=("item_id", "terms"))
    return best.select(F.col("id").alias("doc_id"), F.col("query_id").alias("item_id"), "overlap", F.round("score", 6).alias("score"))
