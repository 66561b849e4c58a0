"""Small helpers shared by the text operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.session import shared_folder, ship_package

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1024


def _bytes(said: str) -> int:
    """A size as Spark takes it: 4194304, 4194304b, 4m, 4MB; anything else counts as unlimited."""
    found = re.fullmatch(r"(\d+)\s*([kmg]?)b?", said.strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 1 << 62


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and bound an Arrow batch by rows and bytes, since a text can be very long."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if not 0 < _bytes(str(spark.conf.get(key))) <= most:
            spark.conf.set(key, str(most))
    return ship_package(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def struct_of(fields: dict[str, tuple[pa.DataType, list]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(values, kind) for kind, values in fields.values()], names=list(fields))


def batch_of(fields: dict[str, tuple[pa.DataType, object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, kind) for kind, v in fields.values()], names=list(fields))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def pieces(texts: Iterable[bytes], limit: int, overlap: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Bundles of about ``limit`` bytes: the row number and bytes of each part.

    A text longer than the limit is cut into parts that repeat the last ``overlap`` bytes of the
    part before, so that every window of ``overlap + 1`` bytes lies in exactly one part.
    """
    rows: list[int] = []
    parts: list[bytes] = []
    held = 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            part = text[at:at + limit]
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= limit:
                yield rows, parts
                rows, parts, held = [], [], 0
            if at + limit >= len(text):
                break
            at += limit - overlap
    if rows:
        yield rows, parts


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
