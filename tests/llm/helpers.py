"""Small tables and plain restatements used by the tests of the text operators."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text: str | None) -> list[str]:
    return [w for w in SPACES.split(text or "") if w]


def docs(spark, texts, langs=None, first=0):
    rows = [(first + k, t, langs[k] if langs else "en", f"src{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def stored(spark, frame, folder, name="documents"):
    frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def odd_rows(spark):
    """NULLs in every column, empty and blank texts, repeated rows and ids."""
    long = "lorem ipsum dolor sit amet. " * 4000
    rows = [(1, None, None, None, None), (None, "some words without an id here", None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4),
            (4, "twice the same row of words", "en", "b", 27), (4, "twice the same row of words", "en", "b", 27), (5, long, "en", "b", len(long)),
            (6, "日本語 のテキスト é ß 😀 token = \"aé\"", "ja", None, 3)]
    return spark.createDataFrame(rows, DOCS)
