"""Files that belong to a document, in a folder of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import SparkSession

SCOPE = ("tenant_id", "case_id", "document_id")


class ArtifactFolder:
    """Originals and derived files below ``path``; names are digests, so none leads out of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def place(self, scope: Mapping[str, str]) -> str:
        """The folder of a document, or of a case where no document is named."""
        parts = [hashlib.sha256(str(scope[k]).encode()).hexdigest()[:20] for k in SCOPE if scope.get(k) is not None]
        return "/".join([self.path, *parts])

    def _at(self, scope: Mapping[str, str]):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.place(scope))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def present(self, scope: Mapping[str, str]) -> bool:
        files, where = self._at(scope)
        return files.exists(where)

    def delete(self, scope: Mapping[str, str]) -> bool:
        """Whether there was something to delete; nothing there is no error."""
        files, where = self._at(scope)
        return files.delete(where, True) if files.exists(where) else False
