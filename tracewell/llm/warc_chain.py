"""WARC archives of pages, and their reading by verified record chains (operator 9).

Writing: one record per page through the text sink, each payload once, repeats as revisit records.
Reading: every place with the magic of a record is a candidate with the offset of its successor, also
inside payloads. Pointer jumping from the start of each file keeps the candidates that the chain of
records really reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import batch_of
from tracewell.session import cut_lineage, shared_folder

HEADER = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n((?:[!-9;-~]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)+)\r\n")
GZIP = b"\x1f\x8b"
RECORDS_PER_FILE = 1024
DATE = "1970-01-01T00:00:00Z"


def base32_of(hexadecimal: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal digits: five of them make four letters."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, html: Column | None) -> Column:
    """Header lines, an empty line and the block; the sink adds the two line ends after it."""
    def name(key: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(">"))

    lines = [F.lit("WARC/1.0"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), name("page_id")), F.lit(f"WARC-Date: {DATE}"),
             F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%20")),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of(F.col("sha"))),
             F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string"))]
    if html is None:
        lines += [F.concat(F.lit("WARC-Refers-To: "), name("first")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  F.lit("Content-Length: 0")]
    else:
        lines += [F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.col("size").cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), html if html is not None else F.lit(""))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of (page_id, url, html), in gzip files below ``folder``.

    Of the records with equal payloads of at least ``least_bytes`` bytes the one with the largest
    page_id is the response and the others refer to it; smaller payloads are all responses. NULL
    html is an empty payload. Rows that repeat page_id and payload of a response are responses too;
    a NULL page_id counts as smaller than any other.
    """
    held = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    held = held.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    slim = cut_lineage(held.select("page_id", "url", "sha", "size"))
    first = slim.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    answers = held.join(first.select(F.col("sha").alias("s"), F.col("size").alias("z"), "first"),
                        F.col("page_id").eqNullSafe(F.col("first")) & (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")), "left_semi")
    if least_bytes > 0:
        answers = answers.unionByName(held.where(F.col("size") < least_bytes))
    again = slim.join(first.where("n > 1"), ["sha", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    records = answers.select(_record("response", F.col("html")).alias("value")).union(again.select(_record("revisit", None).alias("value")))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


RECORD = "page_id long, kind string, refers_to long, bytes long, digest string, sound boolean, uri string, record_id string"


def unpacked(content: bytes) -> bytes:
    """An archive's bytes: all gzip members one after the other, or as they are if it is not packed."""
    return gzip.decompress(content) if content[:2] == GZIP else content


def fields_of(lines: bytes) -> dict[bytes, bytes]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    pairs = (line.partition(b":") for line in re.sub(rb"\r\n[ \t]+", b" ", lines).split(b"\r\n"))
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _payload(block: bytes, kind: bytes) -> bytes:
    """What a block carries: of an HTTP message the part after its header."""
    return block.partition(b"\r\n\r\n")[2] if kind.lower().startswith(b"application/http") else block


def _record_at(data: bytes, found: re.Match) -> dict:
    """The record that a header claims, with the offset of its successor (None if it does not end as a record does)."""
    fields = fields_of(found[1])
    length = fields.get(b"content-length", b"")
    end = found.end() + int(length) if length.isdigit() else len(data)
    whole = data[end:end + 4] == b"\r\n\r\n"
    payload = _payload(data[found.end():end], fields.get(b"content-type", b"")) if whole else b""
    kind = fields.get(b"warc-type", b"").decode("latin-1")
    way, _, told = fields.get(b"warc-payload-digest", b"").decode("latin-1").rpartition(":")
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    again = kind == "revisit"
    full = fields.get(b"x-payload-length", b"")
    ids = [re.fullmatch(rb"<urn:page:(-?\d*)>", fields.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to")]
    page, target = (int(m[1]) if m and m[1].strip(b"-") else None for m in ids)
    return {"at": found.start(), "next": end + 4 if whole else None, "page_id": page, "kind": kind, "refers_to": target,
            "bytes": int(full) if again and full.isdigit() else len(payload), "digest": told if again else own,
            # Only a SHA-1 can be compared; a revisit holds no payload to compare.
            "sound": whole and (again or way.lower() != "sha1" or told.upper() == own),
            "uri": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "record_id": fields.get(b"warc-record-id", b"").decode("latin-1")}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place that looks like a record: its offset, the offset after it, and its fields."""
    kinds = {"at": pa.int64(), "next": pa.int64(), "page_id": pa.int64(), "kind": pa.string(), "refers_to": pa.int64(), "bytes": pa.int64(),
             "digest": pa.string(), "sound": pa.bool_(), "uri": pa.string(), "record_id": pa.string()}
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = unpacked(content.as_py())
            rows = [_record_at(data, found) for found in HEADER.finditer(data)]
            yield batch_of({"file": (pa.string(), [path] * len(rows))} | {k: (kind, [r[k] for r in rows]) for k, kind in kinds.items()})


def reached(candidates: DataFrame) -> DataFrame:
    """The candidates (file, at, next, ...) on the chain that starts at offset 0 of each file.

    Pointers double in each round, so the rounds grow with the logarithm of the records in a file.
    """
    starts = candidates.select("file", "at")
    known = candidates.select("file", "at", F.col("next").alias("to")).join(
        starts.withColumnRenamed("at", "to").withColumn("there", F.lit(True)), ["file", "to"], "left")
    jumps = cut_lineage(known.select("file", "at", F.when(F.col("there"), F.col("to")).alias("to"), (F.col("at") == 0).alias("hit")))
    while not jumps.where("at = 0 AND to IS NOT NULL").isEmpty():
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("onto"))
        met = jumps.where("hit AND to IS NOT NULL").select("file", F.col("to").alias("at")).distinct().withColumn("met", F.lit(True))
        jumps = cut_lineage(jumps.join(onward, ["file", "to"], "left").join(met, ["file", "at"], "left").select(
            "file", "at", F.col("onto").alias("to"), (F.col("hit") | F.coalesce("met", F.lit(False))).alias("hit")))
    return candidates.join(jumps.where("hit").select("file", "at"), ["file", "at"], "left_semi")


def read(spark, folder: str) -> DataFrame:
    """The true records of all archives (.warc, .gz) below ``folder``, of any type, which ``kind`` names.

    Packed archives may consist of one gzip member or of one per record. Payload magic that no chain
    reaches is left out. ``bytes`` and ``digest`` are those of the payload, without an HTTP header; a
    record id of another form than the one written here gives a NULL ``page_id``. A damaged gzip
    member fails the job. A task unpacks one file whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(folder).select("path", "content")
    return reached(cut_lineage(files.mapInArrow(_candidates, f"file string, at long, next long, {RECORD}")))


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and return one row per record."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, least_bytes)
    return read(spark, folder)


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page as the archives have it."""
    return archived(pages).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                  F.col("kind").alias("record_type"), "refers_to")
