"""Vectors of contents already encoded, in a table bucketed by what they are looked up by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("content_hash", "profile")


class EmbeddingStore:
    """Rows (content_hash, profile, vector); the profile names model, digest and dimension of the encoder.

    The table ``name`` of the catalog lies at ``path`` and is bucketed by the hash, so a join with the contents of
    one profile moves the asking side only, if there are no fewer buckets than shuffle partitions. One writer at a time; a batch written twice after a failure leaves equal rows, of
    which one is read.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name = spark, name
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (content_hash STRING, profile STRING, vector ARRAY<FLOAT>) USING parquet "
                  f"CLUSTERED BY (content_hash) INTO {int(buckets)} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    @staticmethod
    def asked(texts: DataFrame, text: str, profile: str) -> DataFrame:
        """The texts with their key; the hash is of the whole text."""
        return texts.withColumns({"content_hash": F.sha2(F.col(text), 256), "profile": F.lit(profile)})

    def missing(self, texts: DataFrame, text: str, profile: str) -> DataFrame:
        """One row (content_hash, profile, text) for each content that has no vector yet."""
        own = self.asked(texts.where(F.col(text).isNotNull()), text, profile).groupBy(*KEY).agg(F.first(text).alias(text))
        return own.join(self.rows().select(*KEY), list(KEY), "left_anti")

    def add(self, texts: DataFrame, text: str, profile: str, encode) -> None:
        """Encode what is missing and append it; each content is encoded once."""
        fresh = self.missing(texts, text, profile).withColumn("vector", encode(F.col(text)).cast("array<float>"))
        fresh.select(*KEY, "vector").write.insertInto(self.name)

    def vectors(self, texts: DataFrame, text: str, profile: str, *keep: str | Column) -> DataFrame:
        """The kept columns of the texts with their vectors; one without a vector has NULL."""
        held = self.rows().groupBy(*KEY).agg(F.first("vector").alias("vector"))
        return self.asked(texts, text, profile).join(held, list(KEY), "left").select(*keep, "vector")
