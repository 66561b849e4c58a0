"""Scoring many texts against a bounded set of queries in one scan, without a shuffle of texts.

Each task scores its Arrow batches with matrix products and keeps only running top lists or
counters, so what leaves a task is bounded by queries x k and never by the pairs. A query set
above ``QUERY_BLOCK`` queries or ``BLOCK_TERMS`` terms is processed in several passes, so the
block shipped to the tasks and the tables made there are always of a checked size. (One query of
more terms than that is a block by itself.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import lexical_words
from tracewell.operators.topk import top_k

QUERY_BLOCK = 512
BLOCK_TERMS = 20_000
SUB_BATCH = 512
CELLS = 1 << 22
K1, B = 1.5, 0.75  # fixed values of the BM25 formula
DIGITS = 9  # scores are compared at this precision, so summation order cannot change a rank

_WORD = re.compile(r"[가-힣a-z]+|\d+(?:[.,]\d+)*")


def query_tokens(text: str) -> list[str]:
    words = _WORD.findall(" ".join(text.lower().replace("ㆍ", " ").split()))
    return words + ["c2:" + w[i:i + 2] for w in words if not w[0].isdigit() for i in range(len(w) - 1)]


@dataclass(frozen=True)
class QueryBlock:
    """Everything a task needs to score one batch; size bounded by ``QUERY_BLOCK`` queries."""

    ids: list
    texts: list[str]
    vectors: np.ndarray | None = None
    vocabulary: dict[str, int] = field(default_factory=dict)
    counts: np.ndarray | None = None  # terms x queries, occurrences in the query
    idf: np.ndarray | None = None
    mean_length: float = 1.0


def query_blocks(queries: DataFrame, id_col: str, text_col: str | None, vector_col: str | None) -> Iterator[QueryBlock]:
    """Read the query side block by block; more than one block means more than one pass."""
    columns = [F.col(id_col).alias("i")]
    columns.append((F.col(text_col) if text_col else F.lit("")).alias("t"))
    if vector_col:
        columns.append(F.col(vector_col).alias("v"))
    for rows in _bounded(queries.select(*columns).orderBy("i"), lambda r: query_tokens(r["t"] or "")):
        yield _block(rows, bool(vector_col))


def _bounded(queries: DataFrame, terms_of) -> Iterator[list]:
    """Rows in blocks of bounded number and bounded distinct terms, read one partition at a time."""
    held: list = []
    seen: set = set()
    for row in queries.toLocalIterator():
        own = set(terms_of(row))
        if held and (len(held) == QUERY_BLOCK or len(seen | own) > BLOCK_TERMS):
            yield held
            held, seen = [], set()
        held.append(row)
        seen |= own
    if held:
        yield held


def _rows_at_once(width: int) -> int:
    """Rows whose table over ``width`` terms stays within ``CELLS``."""
    return max(1, min(SUB_BATCH, CELLS // max(1, width)))


def _block(rows: list, with_vectors: bool) -> QueryBlock:
    tokens = [query_tokens(r["t"] or "") for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in tokens for t in ts}))}
    counts = np.zeros((len(vocabulary), len(rows)))
    for q, ts in enumerate(tokens):
        for t in ts:
            counts[vocabulary[t], q] += 1
    vectors = np.array([r["v"] for r in rows], dtype=np.float64) if with_vectors else None
    return QueryBlock([r["i"] for r in rows], [r["t"] for r in rows], vectors, vocabulary, counts)


#: Words whose places in the block are remembered by a task; rare ones are looked up again.
WORDS = 1 << 16


class _TermCounter:
    """Term frequencies of the block vocabulary for a batch of word lists."""

    def __init__(self, vocabulary: dict[str, int], with_bigrams: bool):
        self.vocabulary, self.with_bigrams = vocabulary, with_bigrams
        self.seen: dict[str, tuple[tuple[int, ...], int]] = {}

    def _hits(self, word: str) -> tuple[tuple[int, ...], int]:
        got = self.seen.get(word)
        if got is None:
            parts = [word]
            if self.with_bigrams and not word[0].isdigit():
                parts += ["c2:" + word[i:i + 2] for i in range(len(word) - 1)]
            got = (tuple([self.vocabulary[p] for p in parts if p in self.vocabulary]), len(parts))  # words without any share one
            if len(self.seen) >= WORDS:
                self.seen.clear()
            self.seen[word] = got
        return got

    def __call__(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(words.offsets.to_numpy())
        flat = words.flatten().dictionary_encode()
        hits = [self._hits(w) for w in flat.dictionary.to_pylist()]
        codes = flat.indices.to_numpy()
        row = np.repeat(np.arange(len(words)), sizes)
        tokens = np.array([h[1] for h in hits], dtype=np.int64)
        length = np.bincount(row, weights=tokens[codes] if len(hits) else None, minlength=len(words))
        width = len(self.vocabulary)
        if not len(hits) or not width:
            return np.zeros((len(words), width)), length
        fan = np.array([len(h[0]) for h in hits], dtype=np.int64)
        start = np.cumsum(fan) - fan
        columns = np.array([c for h in hits for c in h[0]], dtype=np.int64)
        many = fan[codes]
        first = np.repeat(start[codes], many)
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        cell = np.repeat(row, many) * width + columns[first + inner]
        frequency = np.bincount(cell, minlength=len(words) * width).reshape(len(words), width)
        return frequency.astype(np.float64), length


def _dense(vectors: pa.Array, queries: np.ndarray) -> np.ndarray:
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    if matrix.shape[1] != queries.shape[1]:
        raise ValueError(f"vector dimension {matrix.shape[1]} differs from query dimension {queries.shape[1]}")
    size = np.maximum(np.sqrt((matrix * matrix).sum(1)), 1e-12)
    query_size = np.maximum(np.sqrt((queries * queries).sum(1)), 1e-12)
    return (matrix @ queries.T) / (size[:, None] * query_size[None, :])


def _lexical(counter: _TermCounter, words: pa.ListArray, block: QueryBlock) -> np.ndarray:
    frequency, length = counter(words)
    scale = K1 * (1.0 - B + B * length / max(block.mean_length, 1e-9))
    gain = block.idf * frequency * (K1 + 1.0) / (frequency + scale[:, None])
    return gain @ np.minimum(block.counts, 2.0)


def _scores(batches: Iterator[pa.RecordBatch], block: QueryBlock):
    """(ids, dense, lexical) for every sub-batch; an unused side is all zero."""
    counter = _TermCounter(block.vocabulary, True)
    step = _rows_at_once(len(block.vocabulary))
    for whole in batches:
        names = whole.schema.names
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            shape = (len(ids), len(block.ids))
            dense = _dense(batch.column("vector"), block.vectors) if "vector" in names else np.zeros(shape)
            lexical = _lexical(counter, batch.column("words"), block) if "words" in names else np.zeros(shape)
            yield ids, np.round(dense, DIGITS), np.round(lexical, DIGITS)


def _with_statistics(side: DataFrame, block: QueryBlock) -> QueryBlock:
    """Corpus size, mean length and document frequency over the whole corpus, one scan."""
    vocabulary = block.vocabulary

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _TermCounter(vocabulary, True)
        step = _rows_at_once(len(vocabulary))
        rows, tokens, found = 0, 0.0, np.zeros(len(vocabulary), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                frequency, length = counter(whole.slice(at, step).column("words"))
                rows, tokens = rows + len(length), tokens + float(length.sum())
                found += (frequency > 0).sum(0)
        keys = np.concatenate([[-2, -1], np.nonzero(found)[0]])
        values = np.concatenate([[rows, tokens], found[found > 0]])
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"k": keys.astype("int64"), "n": values.astype("float64")}))

    sums = side.select("words").mapInArrow(partial, "k long, n double").groupBy("k").agg(F.sum("n").alias("n"))
    total = {r["k"]: r["n"] for r in sums.collect()}  # at most |vocabulary of the block| + 2 rows
    count = max(total.get(-2, 0.0), 1.0)
    frequency = np.array([total.get(i, 0.0) for i in range(len(vocabulary))])
    idf = np.where(frequency > 0, np.log(1.0 + (count - frequency + 0.5) / (frequency + 0.5)), 0.0)
    mean = total.get(-1, 0.0) / count if total.get(-2, 0.0) else 1.0
    return QueryBlock(block.ids, block.texts, block.vectors, vocabulary, block.counts, idf, mean)


def _side(corpus: DataFrame, id_col: str, text_col: str | None, vector_col: str | None, eligible: Column | None) -> DataFrame:
    """What scoring reads of the eligible rows; the filter comes first, so partitions are pruned by it."""
    columns = [F.col(id_col).alias("id")]
    if text_col:
        columns.append(lexical_words(F.col(text_col)).alias("words"))
    if vector_col:
        columns.append(F.col(vector_col).alias("vector"))
    return (corpus if eligible is None else corpus.where(eligible)).select(*columns)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score descending, then id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.nonzero(scores >= cut)[0]
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


_HIT = "side int, q int, id long, dense double, lexical double"


def _partial_top(side: DataFrame, block: QueryBlock, k: int, sides: tuple[int, ...]) -> DataFrame:
    """Per task and query the k best rows by dense (0) and/or lexical (1) score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for ids, dense, lexical in _scores(batches, block):
            for which in sides:
                for q in range(len(block.ids)):
                    old = kept.get((which, q))
                    fresh = (ids, dense[:, q], lexical[:, q])
                    key = fresh[1 + which]
                    if old is not None and len(old[0]) >= k:
                        keep = key >= old[1 + which][-1]
                        fresh = tuple(a[keep] for a in fresh)
                    if old is not None:
                        fresh = tuple(np.concatenate([a, b]) for a, b in zip(old, fresh))
                    order = _best(fresh[1 + which], fresh[0], k)
                    kept[(which, q)] = tuple(a[order] for a in fresh)
        for (which, q), (ids, dense, lexical) in kept.items():
            yield pa.RecordBatch.from_pydict({
                "side": pa.array([which] * len(ids), pa.int32()), "q": pa.array([q] * len(ids), pa.int32()),
                "id": pa.array(ids, pa.int64()), "dense": pa.array(dense), "lexical": pa.array(lexical)})

    return side.mapInArrow(run, _HIT)


def _global_top(partial: DataFrame, k: int) -> DataFrame:
    by = F.when(F.col("side") == 0, F.col("dense")).otherwise(F.col("lexical"))
    return top_k(partial.withColumn("_s", by), ["side", "q"], [F.desc("_s"), F.asc("id")], k, "id")


def _query_ids(spark, block: QueryBlock, queries: DataFrame, id_col: str) -> DataFrame:
    kind = queries.schema[id_col].dataType.simpleString()
    return F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), f"q int, query_id {kind}"))


def search(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    k: int,
    by: str,
    doc: tuple[str, str],
    query: tuple[str, str],
    eligible: Column | None = None,
) -> DataFrame:
    """Exact top-k per query by ``by`` = "dense" (cosine) or "lexical" (BM25).

    ``doc`` and ``query`` name (id column, vector or text column). BM25 statistics always
    come from the whole corpus, also when ``eligible`` narrows what may be returned.
    Result: query_id, rank, id, score.
    """
    spark = corpus.sparkSession
    dense = by == "dense"
    out = None
    for block in query_blocks(queries, query[0], None if dense else query[1], query[1] if dense else None):
        side = _side(corpus, doc[0], None if dense else doc[1], doc[1] if dense else None, eligible)
        if not dense:
            block = _with_statistics(_side(corpus, doc[0], doc[1], None, None), block)
        top = _global_top(_partial_top(side, block, k, (0,) if dense else (1,)), k)
        part = top.join(_query_ids(spark, block, queries, query[0]), "q").select(
            "query_id", "rank", "id", F.col("_s").alias("score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = queries.schema[query[0]].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank int, id long, score double")
    return out


def hybrid_search(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    doc: tuple[str, str, str],
    query: tuple[str, str, str],
    k: int = 5,
    candidates: int = 50,
    rrf_k: int = 60,
    eligible: Column | None = None,
    boost: Column | None = None,
    attributes: tuple[str, ...] = (),
) -> DataFrame:
    """Fuse exact cosine and BM25 ranks by reciprocal rank.

    Candidates are the first ``candidates`` rows of either ranking. Each candidate needs its
    exact rank on both sides, also far down the list: a second scan counts the rows ahead of
    each candidate, so no ranking of the whole corpus is ever sorted or shuffled. ``boost`` is
    an expression over ``attributes`` of the document and ``query_text``.
    """
    spark = corpus.sparkSession
    doc_id, doc_text, doc_vector = doc
    out = None
    for block in query_blocks(queries, *query):
        side = _side(corpus, doc_id, doc_text, doc_vector, eligible)
        block = _with_statistics(_side(corpus, doc_id, doc_text, None, None), block)
        top = _global_top(_partial_top(side, block, candidates, (0, 1)), candidates)
        rows = top.select("q", "id", "dense", "lexical").distinct().collect()  # <= 2 x candidates x block
        counted = _ranks(side, block, [tuple(r) for r in rows])
        part = counted.join(_query_ids(spark, block, queries, query[0]), "q")
        part = part.withColumn("score", 1.0 / (rrf_k + F.col("dense_rank")) + 1.0 / (rrf_k + F.col("lexical_rank")))
        if boost is not None:
            texts = F.broadcast(spark.createDataFrame(list(enumerate(block.texts)), "q int, query_text string"))
            held = corpus if eligible is None else corpus.where(eligible)
            held = held.select(F.col(doc_id).alias("id"), *attributes)
            part = held.join(F.broadcast(part), "id").join(texts, "q").withColumn("score", F.col("score") + boost)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = queries.schema[query[0]].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank int, id long, score double, dense_score double, "
                                         "lexical_score double, dense_rank long, lexical_rank long")
    best = top_k(out, ["query_id"], [F.desc("score"), F.desc("dense"), F.asc("id")], k, "id", salts=1)
    return best.select("query_id", "rank", "id", "score", F.col("dense").alias("dense_score"),
                       F.col("lexical").alias("lexical_score"), "dense_rank", "lexical_rank")


def _ranks(side: DataFrame, block: QueryBlock, rows: list[tuple]) -> DataFrame:
    """Rank of each candidate on both sides = 1 + rows strictly ahead of it."""
    groups: dict[int, np.ndarray] = {}
    for q in range(len(block.ids)):
        mine = [r for r in rows if r[0] == q]
        if mine:
            groups[q] = np.array([(r[1], r[2], r[3]) for r in mine], dtype=[("id", "i8"), ("d", "f8"), ("l", "f8")])
    # Candidates of each query and side from the best on, and their negated scores for bisection.
    order = {(q, s): np.lexsort((g["id"], -g["dl"[s]])) for q, g in groups.items() for s in range(2)}
    bars = {(q, s): -groups[q]["dl"[s]][o] for (q, s), o in order.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = {k: np.zeros(len(o) + 1, dtype=np.int64) for k, o in order.items()}
        for ids, dense, lexical in _scores(batches, block):
            for (q, s), bar in bars.items():
                have = -(dense, lexical)[s][:, q]
                first, beyond = np.searchsorted(bar, have, "left"), np.searchsorted(bar, have, "right")
                # A row is ahead of all candidates from ``beyond`` on; among equal scores the id decides.
                for row in np.flatnonzero(first != beyond):
                    beyond[row] = first[row] + np.searchsorted(groups[q]["id"][order[q, s][first[row]:beyond[row]]], ids[row], "right")
                ahead[q, s] += np.bincount(beyond, minlength=len(bar) + 1)
        for q, g in groups.items():
            n = np.zeros((2, len(g)), dtype=np.int64)
            for s in range(2):
                n[s][order[q, s]] = np.cumsum(ahead[q, s])[:-1]
            yield pa.RecordBatch.from_pydict({
                "q": pa.array([q] * len(g), pa.int32()), "id": pa.array(g["id"]), "d": pa.array(n[0]), "l": pa.array(n[1])})

    counts = side.mapInArrow(run, "q int, id long, d long, l long").groupBy("q", "id").agg(
        (F.sum("d") + 1).alias("dense_rank"), (F.sum("l") + 1).alias("lexical_rank"))
    known = side.sparkSession.createDataFrame(rows, "q int, id long, dense double, lexical double")
    return counts.join(F.broadcast(known), ["q", "id"])


def best_overlap(
    corpus: DataFrame, queries: DataFrame, *, doc: tuple[str, str], query: tuple[str, str]
) -> DataFrame:
    """For each document the query with the largest set cosine of distinct terms.

    ``doc`` and ``query`` name (id column, column with distinct terms). Rows without a shared
    term are left out. Result: id, query_id, overlap, score.
    """
    spark = corpus.sparkSession
    held = corpus.select(F.col(doc[0]).alias("id"), F.col(doc[1]).alias("words"))
    out = None
    for block in _term_blocks(queries, *query):
        ids, vocabulary, member = block
        sizes = member.sum(0)

        def run(batches, ids=ids, vocabulary=vocabulary, member=member, sizes=sizes):
            counter = _TermCounter(vocabulary, False)
            step = _rows_at_once(len(vocabulary))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    have, length = counter(batch.column("words"))
                    shared = have @ member
                    scale = np.maximum(1.0, np.sqrt(length[:, None] * sizes[None, :]))
                    score = shared / scale
                    pick = score.argmax(1)  # first of equals: the smallest id
                    at_row = np.arange(len(pick))
                    ok = shared[at_row, pick] > 0
                    yield pa.RecordBatch.from_pydict({
                        "id": batch.column("id").filter(pa.array(ok)),
                        "query_id": pa.array(np.array(ids)[pick[ok]], pa.int64()),
                        "overlap": pa.array(shared[at_row, pick][ok].astype(np.int64)),
                        "score": pa.array(score[at_row, pick][ok])})

        part = held.mapInArrow(run, "id long, query_id long, overlap long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "id long, query_id long, overlap long, score double")
    best = out.groupBy("id").agg(F.max_by(F.struct("query_id", "overlap", "score"), F.struct("score", -F.col("query_id"))).alias("b"))
    return best.select("id", "b.query_id", "b.overlap", "b.score")


def _term_blocks(queries: DataFrame, id_col: str, terms_col: str):
    def build(rows):
        vocabulary = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["t"]}))}
        member = np.zeros((len(vocabulary), len(rows)))
        for q, r in enumerate(rows):
            for t in r["t"]:
                member[vocabulary[t], q] = 1.0
        return [r["i"] for r in rows], vocabulary, member

    for rows in _bounded(queries.select(F.col(id_col).alias("i"), F.col(terms_col).alias("t")).orderBy("i"), lambda r: r["t"]):
        yield build(rows)
