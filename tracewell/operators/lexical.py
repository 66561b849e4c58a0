"""Term statistics over a corpus, as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.spans import counted_tokens
from tracewell.functions.text import let, lexical_tokens, text_of


def tokenized(corpus: DataFrame, id_col: str, text: Column) -> DataFrame:
    return corpus.select(F.col(id_col), lexical_tokens(text).alias("tokens"))


def term_counts(tokens: DataFrame, id_col: str) -> DataFrame:
    """(document, counts), an array of (term, tf), without a shuffle.

    All tokens of a text are in its row: sort them, find where each run starts, and the
    distance to the next start is the frequency.
    """
    def starts(t: Column) -> Column:
        return F.when(F.size(t) > 0, F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1))))

    def counted(r: Column) -> Column:
        return F.transform(r["s"], lambda i, k: F.struct(
            F.get(r["t"], i).alias("term"), (F.coalesce(F.get(r["s"], k + 1), F.size(r["t"])) - i).cast("long").alias("tf")))

    runs = let(F.sort_array("tokens"), lambda t: F.struct(t.alias("t"), starts(t).alias("s")))
    return tokens.select(id_col, let(runs, counted).alias("counts"))


def text_counts(corpus: DataFrame, id_col: str, text: Column) -> DataFrame:
    """What ``term_counts`` gives of the tokens of a text, in any order and without making them one by one.

    Texts without a token have an empty array.
    """
    return corpus.select(F.col(id_col), counted_tokens(F.lower(text_of(text))).alias("counts"))


def term_frequency(tokens: DataFrame, id_col: str) -> DataFrame:
    """One row (document, term, tf) per distinct term."""
    # The outer form: an inner one makes the optimizer evaluate the array once more in a filter.
    return term_counts(tokens, id_col).select(id_col, F.inline_outer("counts")).where("term IS NOT NULL")


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))


def corpus_size(tokens: DataFrame) -> DataFrame:
    """One row: number of texts and mean length."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def inverse_frequency(tokens: DataFrame) -> DataFrame:
    """idf = ln(1 + (N - df + 0.5) / (df + 0.5)); the corpus size is one count."""
    n = tokens.count()
    frequency = document_frequency(tokens)
    return frequency.withColumn("idf", F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
