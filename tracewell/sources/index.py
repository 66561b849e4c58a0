"""Chunk index as a partitioned Parquet dataset.

Layout: tenant_id / case_id / bucket, the bucket being a hash of the document id. An upsert or
delete rewrites only the buckets it touches; a scoped search reads only its case. Spark's
commit protocol replaces a lock and a rename. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.retrieval import overlap_filter, overlap_filter_arrays, require_scope
from tracewell.operators.scoring import hybrid_search
from tracewell.operators.upsert import SCOPE, delete_scope, replace_documents, require_unique
from tracewell.session import shared_folder

PLACE = ("tenant_id", "case_id", "bucket")


class ChunkIndex:
    """Chunks with vectors: tenant_id, case_id, document_id, chunk_id, embedding_text, vector, ..."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # -- metadata ---------------------------------------------------------------------------

    def _files(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def exists(self) -> bool:
        return self._files().exists(self._path("_meta"))

    def metadata(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_meta").first()["value"])

    def _check(self, metadata: Mapping[str, object]) -> None:
        """Level, model and dimension must agree with what is stored."""
        held = self.metadata()
        wrong = [k for k in ("representation_level", "model_id", "model_sha256", "dimension") if held.get(k) != metadata.get(k)]
        if wrong:
            raise ValueError(f"index is not compatible: {wrong}")

    # -- reading ----------------------------------------------------------------------------

    def read(self, filters: Mapping[str, object] | None = None) -> DataFrame:
        # The stored schema keeps an emptied index readable.
        schema = T.StructType.fromJson(self.metadata()["schema"])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data")
        for key, value in (filters or {}).items():
            rows = rows.where(F.col(key).eqNullSafe(F.lit(value)) if value is None else F.col(key) == F.lit(value))
        return rows

    def count(self, filters: Mapping[str, object] | None = None) -> int:
        return self.read(filters).count()

    def stats(self) -> DataFrame:
        return self.read().groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("records")).orderBy(*SCOPE)

    def search(self, queries: DataFrame, filters: Mapping[str, object], k: int = 5, **options) -> DataFrame:
        """Hybrid search for (query_id, text, vector); tenant and case must be given.

        A filter value may be a list, and so may an index column: a row passes when the two meet.
        BM25 statistics come from the whole index; scoring and ranking read the named cases only, whose
        files are compared with the manifest before.
        """
        require_scope(filters)
        self.verify(filters)
        rows = self.read()
        lists = {f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType)}
        plain = {k: v for k, v in filters.items() if k not in lists}
        eligible = overlap_filter({k: F.col(k) for k in plain if k in rows.columns}, plain)
        for key in filters.keys() & lists:
            value = filters[key]
            eligible = eligible & overlap_filter_arrays(F.col(key), list(value) if isinstance(value, (list, tuple, set)) else [value])
        return hybrid_search(rows, queries, doc=("chunk_no", "embedding_text", "vector"),
                             query=("query_id", "text", "vector"), k=k, eligible=eligible, **options)

    # -- writing ----------------------------------------------------------------------------

    def _placed(self, rows: DataFrame) -> DataFrame:
        number = F.xxhash64(*SCOPE, "chunk_id")
        return rows.withColumns({
            "bucket": F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int"), "chunk_no": number})

    @staticmethod
    def _by_place(rows: DataFrame) -> DataFrame:
        """Rows of a place together, so that it gets few files; a large place is split over tasks."""
        return rows.hint("rebalance", *[F.col(c) for c in PLACE])

    def _write(self, rows: DataFrame) -> None:
        self._by_place(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(f"{self.path}/data")
        self.spark.catalog.refreshByPath(f"{self.path}/data")

    def create(self, chunks: DataFrame, metadata: Mapping[str, object]) -> None:
        placed = self._placed(chunks)
        require_unique(placed, ["tenant_id", "case_id", "chunk_no"])
        self._by_place(placed).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*PLACE).parquet(f"{self.path}/data")
        self._describe(metadata, placed.schema)
        self.spark.catalog.refreshByPath(f"{self.path}/data")
        self._note_files()

    def _describe(self, metadata: Mapping[str, object], schema: T.StructType) -> None:
        text = json.dumps({**metadata, "schema": json.loads(schema.json())}, ensure_ascii=False)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_meta")

    def upsert(self, chunks: DataFrame, metadata: Mapping[str, object]) -> None:
        """Replace every document that occurs in ``chunks``; all others stay."""
        if not self.exists():
            self.create(chunks, metadata)
            return
        self._check(metadata)
        with self._staged() as write_down:
            newer = write_down(self._placed(chunks))
            require_unique(newer, ["tenant_id", "case_id", "chunk_no"])
            touched = newer.select(*PLACE).distinct()
            near = self.read().join(touched, list(PLACE), "left_semi")
            # The result is written down before the partitions it was read from are replaced.
            merged = write_down(replace_documents(near, newer))
            self._write(merged)
            if set(merged.columns) != set(self.read().columns):
                self._describe(metadata, merged.schema)
            self._note_files(touched)

    def delete(self, **scope: str) -> int:
        """Delete a document or a case; returns the number of removed chunks and verifies zero remain."""
        require_scope(scope)
        removed = self.count(scope)
        if not removed:
            return 0
        near = {k: scope[k] for k in ("tenant_id", "case_id")}
        places = [r[0] for r in self.read(scope).select("bucket").distinct().collect()]  # at most ``buckets``
        with self._staged() as write_down:
            rest = write_down(delete_scope(self.read(near).where(F.col("bucket").isin(places)), scope))
            if not rest.isEmpty():
                self._write(rest)
            kept = {r[0] for r in rest.select("bucket").distinct().collect()}
            for bucket in set(places) - kept:
                for part in ("data", "_manifest"):
                    self._files().delete(self._path(part, f"tenant_id={scope['tenant_id']}", f"case_id={scope['case_id']}", f"bucket={bucket}"), True)
            self.spark.catalog.refreshByPath(f"{self.path}/data")
            if kept:
                self._note_files(rest.select(*PLACE).distinct())
        if self.count(scope):
            raise RuntimeError("deletion could not be verified: chunks remain")
        return removed

    @contextmanager
    def _staged(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Writes rows down as Parquet until the block ends; a checkpoint would hold texts and lists uncompressed."""
        folder = f"{shared_folder(self.spark)}/staged-{uuid.uuid4().hex}"

        def write_down(rows: DataFrame) -> DataFrame:
            place = f"{folder}/{uuid.uuid4().hex}"
            rows.write.parquet(place)
            return self.spark.read.schema(rows.schema).parquet(place)

        try:
            yield write_down
        finally:
            staged = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            staged.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(staged, True)

    # -- manifest ---------------------------------------------------------------------------

    def _digests(self, places: DataFrame | None = None, chosen: Column | None = None) -> DataFrame:
        """Rows and an order-free digest of every data file, of the given places or chosen rows only."""
        rows = self.read().withColumn("file", F.col("_metadata.file_name"))
        plain = [F.to_json(F.col(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in rows.schema if f.name not in (*PLACE, "file")]
        if places is not None:
            rows = rows.join(places, list(PLACE), "left_semi")
        if chosen is not None:
            rows = rows.where(chosen)
        return rows.groupBy(*PLACE, "file").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*plain).cast("decimal(38,0)")).alias("digest"))

    def _note_files(self, places: DataFrame | None = None) -> None:
        """Write down what the given places, or all, now hold."""
        mode = "static" if places is None else "dynamic"
        self._digests(places).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*PLACE).parquet(f"{self.path}/_manifest")

    def corrupt_files(self, filters: Mapping[str, object] | None = None) -> DataFrame:
        """Rows (tenant_id, case_id, bucket, file, said) of the named tenants and cases: files that are missing, altered or unknown.

        Every file is compared with the manifest by its rows and digest.
        """
        wanted = {k: v for k, v in (filters or {}).items() if k in PLACE}
        chosen = overlap_filter({k: F.col(k) for k in wanted}, wanted)
        kinds = {f.name: f.dataType.simpleString() for f in self.read().schema if f.name in PLACE}
        schema = "file string, rows long, digest decimal(38,0), " + ", ".join(f"{k} {kinds[k]}" for k in PLACE)
        told = self.spark.read.schema(schema).parquet(f"{self.path}/_manifest").where(chosen).withColumnsRenamed({"rows": "told_rows", "digest": "told_digest"})
        both = told.join(self._digests(chosen=chosen), [*PLACE, "file"], "full")
        wrong = both.where(~F.col("rows").eqNullSafe(F.col("told_rows")) | ~F.col("digest").eqNullSafe(F.col("told_digest")))
        said = F.when(F.col("rows").isNull(), "missing").when(F.col("told_rows").isNull(), "unknown").otherwise("altered")
        return wrong.select(*PLACE, "file", said.alias("said"))

    def verify(self, filters: Mapping[str, object] | None = None) -> None:
        """Fail, naming files, unless the named tenants and cases hold the rows that were written."""
        found = self.corrupt_files(filters).orderBy("file").limit(5).collect()
        if found:
            raise ValueError("index is corrupt: " + ", ".join(f"{r.file} is {r.said}" for r in found))

    def check_rows(self) -> DataFrame:
        """Rows whose vector is missing or has another dimension than the index says."""
        return self.read().where(F.coalesce(F.size("vector") != int(self.metadata()["dimension"]), F.lit(True)))
