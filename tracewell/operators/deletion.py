"""Deletion of a document or case in steps that a repeated run goes on from."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracewell.operators.retrieval import require_scope
from tracewell.sources.index import ChunkIndex

#: In this order; FAILED may stand between any two.
STEPS = ("DELETING", "VECTORS", "VERIFIED", "ARTIFACTS", "DELETED")
FAILED = "FAILED"
LOG = "run int, number int, status string, chunks long, error string"


class Artifacts(Protocol):
    def delete(self, scope: Mapping[str, str]) -> bool: ...

    def present(self, scope: Mapping[str, str]) -> bool: ...


class Deletion:
    """Vectors first, verified, then files, verified; each done step is written down before the next begins."""

    def __init__(self, index: ChunkIndex, artifacts: Artifacts, log: str):
        self.index, self.artifacts, self.log = index, artifacts, log.rstrip("/")
        self.spark: SparkSession = index.spark

    def _place(self, scope: Mapping[str, str]) -> str:
        said = "\x1f".join(f"{k}={scope[k]}" for k in sorted(scope))
        return f"{self.log}/{hashlib.sha256(said.encode()).hexdigest()[:20]}"

    def history(self, scope: Mapping[str, str]) -> DataFrame:
        """The log of a scope: run, number, status, chunks removed or left, error."""
        try:
            return self.spark.read.schema(LOG).parquet(self._place(scope)).orderBy("run", "number")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def _note(self, scope: Mapping[str, str], row: tuple) -> None:
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(self._place(scope))

    def _step(self, name: str, scope: Mapping[str, str]) -> int:
        if name == "DELETING":
            return self.index.count(scope)
        if name == "VECTORS":
            return self.index.delete(**scope)
        if name == "VERIFIED":
            left = self.index.count(scope)
            if left:
                raise RuntimeError(f"vector deletion could not be verified: {left} chunks remain")
            return left
        if name == "ARTIFACTS":
            self.artifacts.delete(scope)
            if self.artifacts.present(scope):
                raise RuntimeError("file deletion could not be verified")
        return 0

    def run(self, **scope: str) -> str:
        """DELETED or FAILED. A deletion that has ended stays ended; one that failed goes on at the step that failed.

        Verification is never taken from an earlier run: rows may have come back since.
        """
        require_scope(scope)
        rows = self.history(scope).collect()
        done = {r.status for r in rows}
        if "DELETED" in done:
            return "DELETED"
        run = max([r.run for r in rows], default=0) + 1
        if self.index.count(scope):
            done.discard("VECTORS")  # rows have come back, or not all had gone
        for number, name in enumerate(STEPS):
            if name in done and name != "VERIFIED":
                continue
            try:
                chunks = self._step(name, scope)
            except Exception as problem:
                self._note(scope, (run, number, FAILED, self.index.count(scope), str(problem)[:500]))
                return FAILED
            self._note(scope, (run, number, name, chunks, None))
        return "DELETED"

    def status(self, scope: Mapping[str, str]) -> str | None:
        last = self.history(scope).orderBy(F.desc("run"), F.desc("number")).first()
        return last["status"] if last else None
