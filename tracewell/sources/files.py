"""Office, text and PDF files as block rows; workbooks as cell rows.

Spark lists and distributes the files (``binaryFile``); a small stdlib reader opens one file.
A file that cannot be read yields one row with an error, so a batch always completes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SUPPORTED = (".pdf", ".docx", ".xlsx", ".txt", ".md")
#: Rows that are handed on together; one file's rows stay together.
ROWS = 4096
ENCODINGS = ("utf-8-sig", "cp949", "utf-8")

BLOCKS = (T.StructType().add("path", "string").add("block_no", "integer").add("text", "string").add("page", "integer")
          .add("location", "string").add("bbox", T.ArrayType(T.DoubleType())).add("page_size", T.ArrayType(T.DoubleType()))
          .add("error", "string"))
CELLS = (T.StructType().add("path", "string").add("sheet", "string").add("sheet_no", "integer").add("row", "integer")
         .add("col", "integer").add("coordinate", "string").add("value", "string").add("formula", "string")
         .add("source_hash", "string"))

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


@lru_cache(maxsize=4096)
def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and "e" not in text.lower() and "." not in text else str(value)


@lru_cache(maxsize=4096)
def _place(where: str) -> tuple[int, int]:
    """(row, column) of a coordinate such as ``B12``."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", where).groups()
    column = 0
    for ch in letters:
        column = column * 26 + ord(ch) - 64
    return int(digits), column


@lru_cache(maxsize=64)
def _sheets(book: bytes, rels: bytes) -> list[tuple[str, str]]:
    """(sheet, part) in workbook order; workbooks of one layout share these two parts."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(rels)}
    named = [(sheet.get("name"), targets[sheet.get(_REL + "id")].lstrip("/")) for sheet in ElementTree.fromstring(book).iter(_MAIN + "sheet")]
    return [(name, part if part.startswith("xl/") else "xl/" + part) for name, part in named]


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, int, str, str | None, str | None]]:
    """(sheet, sheet_no, row, col, coordinate, value, formula) of every filled cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.NameToInfo:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_MAIN + "si"):
                shared.append("".join(t.text or "" for t in item.iter(_MAIN + "t")))
        for no, (sheet, part) in enumerate(_sheets(book.read("xl/workbook.xml"), book.read("xl/_rels/workbook.xml.rels")), 1):
            for cell in ElementTree.fromstring(book.read(part)).iter(_MAIN + "c"):
                where, kind = cell.get("r"), cell.get("t")
                raw, formula = cell.findtext(_MAIN + "v"), cell.findtext(_MAIN + "f")
                if kind == "inlineStr":
                    value = "".join([t.text or "" for t in cell.iter(_MAIN + "t")])
                elif raw is None:
                    value = None
                elif kind == "s":
                    value = shared[int(raw)]
                elif kind == "b":
                    value = "True" if raw == "1" else "False"
                else:
                    value = raw if kind in ("str", "e", "d") else _number(raw)
                if value is None and formula is None:
                    continue
                yield sheet, no, *_place(where), where, value, None if formula is None else "=" + formula


def _docx(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(_WORD + "body")
    said = lambda node: "".join(t.text or "" for t in node.iter(_WORD + "t"))
    for n, paragraph in enumerate(body.findall(_WORD + "p"), 1):
        if said(paragraph).strip():
            yield said(paragraph).strip(), None, f"paragraph:{n}", None, None
    for k, table in enumerate(body.findall(_WORD + "tbl"), 1):
        for n, row in enumerate(table.findall(_WORD + "tr"), 1):
            cells = [" ".join(" ".join(said(p) for p in c.iter(_WORD + "p")).split()) for c in row.findall(_WORD + "tc")]
            if any(cells):
                yield " | ".join(cells), None, f"table:{k}:row:{n}", None, None


def _xlsx(content: bytes) -> Iterator[tuple]:
    rows: dict[tuple[int, int], list[str]] = {}
    titles: dict[int, str] = {}
    for sheet, no, row, _, where, value, formula in workbook_cells(content):
        titles[no] = sheet
        rows.setdefault((no, row), []).append(f"{where}={formula or value}")
    for (no, row), cells in sorted(rows.items()):
        yield f"시트={titles[no]}; " + "; ".join(cells), None, f"sheet:{titles[no]}:row:{row}", None, None


def _text(content: bytes) -> Iterator[tuple]:
    for encoding in ENCODINGS:
        try:
            yield content.decode(encoding).strip(), None, "text", None, None
            return
        except UnicodeDecodeError:
            continue
    raise ValueError("text encoding is not supported")


def _pdf(content: bytes) -> Iterator[tuple]:
    try:
        import fitz  # optional
    except ImportError as exc:
        raise RuntimeError("PDF extraction needs PyMuPDF on the workers") from exc
    n = 0
    with fitz.open(stream=content, filetype="pdf") as pages:
        for number, page in enumerate(pages, 1):
            for x0, y0, x1, y1, text, *_ in page.get_text("blocks", sort=True):
                if text.split():
                    n += 1
                    yield (" ".join(text.split()), number, f"page:{number}:block:{n}", [x0, y0, x1, y1],
                           [page.rect.width, page.rect.height])


_READERS = {".pdf": _pdf, ".docx": _docx, ".xlsx": _xlsx, ".txt": _text, ".md": _text}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def extract_blocks(files: DataFrame) -> DataFrame:
    """Blocks of every file by suffix; unsupported or broken files give an error row."""
    schema = to_arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns]):
                suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
                try:
                    if suffix not in _READERS:
                        raise ValueError(f"unsupported attachment type: {suffix or 'unknown'}")
                    rows = [(path, i, *b, None) for i, b in enumerate(_READERS[suffix](content), 1)]
                except Exception as exc:  # the row carries the reason; the batch goes on
                    rows = [(path, 0, None, None, None, None, None, f"{type(exc).__name__}: {exc}")]
                held += rows
                if len(held) >= ROWS:
                    yield _batch(held, schema)
                    held = []
        if held:
            yield _batch(held, schema)

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def read_cells(files: DataFrame) -> DataFrame:
    """Cell rows of workbooks, with the digest of the file they came from.

    A file's cells leave Python as one array, so its path and digest are passed once a file.
    """
    cell = T.StructType([f for f in CELLS if f.name not in ("path", "source_hash")])
    books = T.StructType().add("path", "string").add("source_hash", "string").add("cells", T.ArrayType(cell))
    fields = to_arrow_schema(cell)
    schema = to_arrow_schema(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        named: list[tuple] = []
        ends = [0]

        def handed() -> pa.RecordBatch:
            parts = [pa.array(column, f.type) for column, f in zip(zip(*held), fields)]
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(fields)))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in zip(*named)], cells.cast(schema.field("cells").type)], schema=schema)

        for batch in batches:
            for path, content, digest in zip(*[c.to_pylist() for c in batch.columns]):
                held += workbook_cells(content)
                named.append((path, digest))
                ends.append(len(held))
                if len(held) >= ROWS:
                    yield handed()
                    held, named, ends = [], [], [0]
        if held:
            yield handed()

    read = files.select("path", "content", F.sha2("content", 256).alias("source_hash")).mapInArrow(run, books)
    return read.select("path", "source_hash", F.inline("cells")).select(*CELLS.names)
