"""BM25 over stored postings with block maxima: blocks that cannot reach a query's top k are not read.

Documents are ordered by their most frequent word, which tells languages and subjects apart, and by length,
and dealt into blocks of ``BLOCK``, so that those of a block are alike and its bounds close. A posting row
holds the documents of one term in one block with their gains, and the largest of these. What a block can give a query is at
most the weighted sum of its terms' largest gains. The most promising blocks of each query are read
first; of the others only those that may still beat its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.text import lexical_tokens
from tracewell.operators.lexical import term_frequency, text_counts
from tracewell.operators.places import column, meet
from tracewell.operators.scoring import B, DIGITS, K1
from tracewell.session import cut_lineage

#: Documents of a block, a power of two.
BLOCK = 64
#: Blocks of each query that are read first.
FIRST = 2
#: Sums in another order may differ by this much.
SLACK = 1e-8

POSTING = "term string, block long, n long, most double, ids array<long>, gains array<double>"


class Postings:
    """The index in a folder: postings by term and block, and the two numbers of the corpus."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, corpus: DataFrame, id_col: str, text_col: str) -> Postings:
        """Write the postings of all texts; each text is tokenised once and its terms are never shuffled one by one."""
        counts = text_counts(corpus.withColumnRenamed(id_col, "id"), "id", F.col(text_col))
        counted = counts.withColumn("size", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["tf"]))
        words = F.filter("counts", lambda x: ~x["term"].startswith("c2:"))
        lead = F.array_max(F.transform(words, lambda x: F.struct(x["tf"], x["term"])))["term"]
        counted = cut_lineage(counted.select("id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), lead.alias("lead"), "counts"))
        counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean")).write.mode("overwrite").parquet(f"{self.path}/corpus")
        mean = max(self._corpus()[1], 1e-9)

        def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            now = None
            for batch in batches:
                block = batch.column("block").to_numpy()
                cuts = np.flatnonzero(np.diff(block)) + 1
                for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                    if begin < end:
                        if block[begin] != now and held:
                            yield posted(pa.Table.from_batches(held), now)
                            held = []
                        now = block[begin]
                        held.append(batch.slice(begin, end - begin))
            if held:
                yield posted(pa.Table.from_batches(held), now)

        def posted(docs: pa.Table, block: int) -> pa.RecordBatch:
            lists = column(docs, "counts")
            number = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, flat = np.repeat(np.arange(len(number)), number), lists.flatten()
            terms, tf = flat.field("term").dictionary_encode(), flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
            scale = K1 * (1.0 - B + B * column(docs, "size").to_numpy() / mean)
            gain = tf * (K1 + 1.0) / (tf + scale[row])
            code = terms.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            sizes = np.bincount(code, minlength=len(terms.dictionary))
            ends = np.cumsum(sizes)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            ids, gains = column(docs, "id").to_numpy()[row[order]], gain[order]
            most = np.maximum.reduceat(gains, ends - sizes) if len(sizes) else np.zeros(0)
            return pa.RecordBatch.from_arrays([
                terms.dictionary, pa.array(np.full(len(sizes), block), pa.int64()), pa.array(sizes, pa.int64()), pa.array(most, pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(gains))],
                names=["term", "block", "n", "most", "ids", "gains"])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = counted.repartitionByRange(parts, "lead", "size", "id").sortWithinPartitions("lead", "size", "id")
        # Rows of a partition are numbered in a row, so a block never spans two.
        numbered = ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))
        numbered.mapInArrow(blocked, POSTING).write.mode("overwrite").parquet(f"{self.path}/postings")
        counted.select("id").write.mode("overwrite").parquet(f"{self.path}/ids")
        return self

    def _corpus(self) -> tuple[int, float]:
        row = self.spark.read.parquet(f"{self.path}/corpus").first()
        return row["n"], row["mean"]

    def _read(self) -> DataFrame:
        return self.spark.read.schema(POSTING).parquet(f"{self.path}/postings")

    def _weights(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (query, term, weight) of the terms that some document has, and the maxima of their blocks."""
        terms = term_frequency(queries.select("query", lexical_tokens(F.col("text")).alias("tokens")), "query")
        asked = cut_lineage(terms.select("query", "term", F.least("tf", F.lit(2)).cast("double").alias("times")))
        maxima = cut_lineage(self._read().select("term", "block", "n", "most").join(asked.select("term").distinct(), "term", "left_semi"))
        count = float(self._corpus()[0])
        frequency = maxima.groupBy("term").agg(F.sum("n").alias("df"))
        idf = frequency.select("term", F.log(1.0 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        return cut_lineage(asked.join(idf, "term").select("query", "term", (F.col("idf") * F.col("times")).alias("weight"))), maxima

    def _score(self, asks: DataFrame, weights: DataFrame, k: int) -> DataFrame:
        """The k best (query, id, score) of each asked (query, block) that reach ``least``."""
        asks = asks.join(weights.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms")), "query")
        needed = asks.select("block", F.explode("terms.term").alias("term")).distinct()
        rows = self._read().select("term", "block", "ids", "gains").join(needed, ["term", "block"], "left_semi").withColumnRenamed("block", "place")

        def build(held: pa.Table):
            ids, where = np.unique(column(held, "ids").flatten().to_numpy(), return_inverse=True)
            gains = column(held, "gains").flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(column(held, "ids")).to_numpy())
            span = {t: (b, e) for t, b, e in zip(column(held, "term").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist())}

            def answer(asked: pa.RecordBatch) -> pa.RecordBatch:
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for query, terms, least in zip(asked.column("query").to_pylist(), asked.column("terms").to_pylist(), asked.column("least").to_pylist()):
                    total = np.zeros(len(ids))
                    for t in terms:
                        begin, end = span.get(t["term"], (0, 0))
                        total[where[begin:end]] += t["weight"] * gains[begin:end]
                    total = np.round(total, DIGITS)
                    found = np.flatnonzero(total >= max(least or 0.0, 10.0 ** -DIGITS))
                    found = found[np.lexsort((ids[found], -total[found]))[:k]]
                    out.append((np.full(len(found), query), ids[found], total[found]))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query", "id", "score"])

            return answer

        return meet(rows, asks.select(F.col("block").alias("place"), "query", "terms", "least"), build, "query long, id long, score double")

    def plan(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(bounds with ``first``, weights, hits of the first blocks, further blocks with ``least``) for queries (query, text)."""
        weights, maxima = self._weights(queries)
        bounds = weights.join(maxima, "term").groupBy("query", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"), F.sum("n").alias("postings"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
        bounds = cut_lineage(bounds.withColumn("first", place <= FIRST))
        hits = cut_lineage(self._score(bounds.where("first").withColumn("least", F.lit(0.0)), weights, k))
        kth = _ranked(hits, k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
        further = bounds.where("NOT first").join(kth, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        return bounds, weights, hits, further

    def search(self, queries: DataFrame, k: int, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
        """Rows (query_id, rank, id, score): the exact k best documents of each query, ties by smaller id.

        Documents without a term of the query score zero and fill up what is missing, smallest ids first.
        """
        named = cut_lineage(queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text")).withColumn("query", F.monotonically_increasing_id()))
        _, weights, hits, further = self.plan(named.select("query", "text"), k)
        best = cut_lineage(_ranked(hits.unionByName(self._score(further, weights, k)), k))
        # At most k of these are hits of one query, so 2 k ids are enough to fill up from.
        smallest = [r.id for r in self.spark.read.parquet(f"{self.path}/ids").orderBy("id").limit(2 * k).collect()]
        few = named.select("query").join(best.groupBy("query").count(), "query", "left").where(F.coalesce("count", F.lit(0)) < k)
        rest = few.select("query", F.explode(F.array(*[F.lit(i).cast("long") for i in smallest]) if smallest else F.expr("cast(array() as array<long>)")).alias("id"))
        zeros = rest.join(best.select("query", "id"), ["query", "id"], "left_anti").withColumn("score", F.lit(0.0))
        whole = _ranked(best.select("query", "id", "score").unionByName(zeros.select("query", "id", "score")), k)
        return whole.join(named.select("query", "query_id"), "query").select("query_id", "rank", "id", "score")

    def work(self, queries: DataFrame, k: int, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
        """Per query the postings of its terms and how many of them a search reads."""
        named = cut_lineage(queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text")).withColumn("query", F.monotonically_increasing_id()))
        bounds, _, _, further = self.plan(named.select("query", "text"), k)
        read = bounds.where("first").select("query", "postings").unionByName(further.select("query", "postings")).groupBy("query").agg(F.sum("postings").alias("read"))
        return named.join(bounds.groupBy("query").agg(F.sum("postings").alias("postings")), "query").join(read, "query").select("query_id", "postings", "read")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
