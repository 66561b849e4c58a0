"""Named queries and, where SQL can express them, an independent SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import ship_package, spread, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.documents`` reads the documents table of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship_package(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def spread(self, name: str, *columns: str) -> DataFrame:
        """A table for CPU-heavy, row-local work; only the named columns are read."""
        held = table(self.spark, self.folder, name)
        return spread(held.select(*columns) if columns else held)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return build

    return register
