"""Chunk records: metadata, Markdown, repeated lines and sections.

A document reaches Spark as one row (nested arrays or a whole text), so everything that works
inside one document is row-local and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import escape_markdown, let, lexical_normalize


def chunk_metadata(chunks: DataFrame, chunk_id: str, body: Column, active: Column, level: int) -> DataFrame:
    return chunks.select(
        F.col(chunk_id).alias("canonical_chunk_id"),
        F.concat(F.col(chunk_id), F.lit(f":L{level}")).alias("variant_id"),
        F.sha2(body, 256).alias("canonical_embedding_sha256"),
        F.length(body).alias("canonical_embedding_chars"),
        F.length(active).alias("active_embedding_chars"),
        F.lit("semantic_linearized" if level == 0 else "experimental_representation").alias("embedding_profile"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_markdown), " | "), F.lit(" |"))


def unrepeated_lines(lines: Column, *, at_least: int = 3, longest: int = 160) -> Column:
    """The lines of a document without those whose normalised text occurs ``at_least`` times in it.

    A document is one row, so nothing is shuffled: of the sorted short lines, one that equals the
    line ``at_least - 1`` places later is repeated.
    """
    held = F.transform(lines, lambda x: F.struct(x.alias("line"), lexical_normalize(x).alias("norm")))

    def cleaned(own: Column) -> Column:
        short = F.array_sort(F.transform(F.filter(own, lambda x: (F.length(x["line"]) <= longest) & (x["norm"] != "")), lambda x: x["norm"]))
        repeated = let(short, lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + at_least - 1) == x)))
        return let(repeated, lambda r: F.transform(F.filter(own, lambda x: ~F.array_contains(r, x["norm"])), lambda x: x["line"]))

    return let(held, cleaned)


def drop_repeated_lines(lines: DataFrame, document: str, line: str, *, at_least: int = 3, longest: int = 160,
                        margin: Column | None = None) -> DataFrame:
    """The same over a table of lines, as blocks of a page arrive, with a test of what lies in the margin."""
    marked = lines.withColumn("_norm", lexical_normalize(F.col(line))).withColumn(
        "_margin", F.lit(True) if margin is None else margin)
    repeated = (
        marked.where(F.col("_margin") & (F.length(line) <= longest) & (F.col("_norm") != ""))
        .groupBy(document, "_norm").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
        .select(document, "_norm", F.lit(True).alias("_margin"))
    )
    return marked.join(repeated, [document, "_norm", "_margin"], "left_anti").drop("_norm", "_margin")
