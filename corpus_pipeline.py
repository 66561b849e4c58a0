"""Stages that turn raw documents into training text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.llm import anchor_simhash, fm_decontaminate, lang_bits, maxplus_pieces, secret_guess
from tracewell.llm.common import prepare, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A language whose filter contains less than this part of a text's n-grams is not believed.
LEAST_HELD = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing label is filled in.

    A NULL or empty text, or one without a letter, goes. Every row is judged by itself, so repeated
    rows share a fate; languages of equal scores go by their order. Other columns stay as they are.
    """
    prepare(spark)
    found = lang_bits.predict(F.col("text"), lang_bits.fit(docs))
    held = docs.withColumn("language found", found).where((F.col("language found.lang") != "und") & (F.col("language found.held") >= LEAST_HELD))
    return held.withColumn("lang", F.coalesce("lang", "language found.lang")).drop("language found")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Of rows with one doc_id and one text a single one stays. NULL and empty texts are one group.
    """
    prepare(spark)
    return anchor_simhash.one_of_each(docs).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item; NULL and empty texts and repeated rows stay."""
    blocks = fm_decontaminate.blocks_of(table(spark, sf_dir, "benchmark"))
    held = docs.withColumn("benchmark found", fm_decontaminate.matches(F.col("text"), blocks))
    return held.where(~fm_decontaminate.contaminated(F.col("benchmark found"))).drop("benchmark found")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; NULL and empty texts stay as they are, repeated rows are masked alike."""
    prepare(spark)
    held = docs.withColumn("text without secrets", secret_guess.masked(F.col("text"), secret_guess.learned(docs)))
    size = F.when(F.col("text").eqNullSafe(F.col("text without secrets")), F.col("n_chars")).otherwise(F.length("text without secrets").cast("long"))
    return held.withColumn("n_chars", size).withColumn("text", F.col("text without secrets")).drop("text without secrets")


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, with the ids of their pieces; none for a NULL or empty text."""
    prepare(spark)
    held = maxplus_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), out_col="piece struct")
    return held.withColumn("n_pieces", F.col("piece struct.n_pieces")).withColumn("piece_ids", F.col("piece struct.ids")).drop("piece struct")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", as_pieces),
]

#: The stages learn models, follow links and encode, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
