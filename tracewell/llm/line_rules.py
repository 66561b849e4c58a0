"""Line-first cleaning (operator 3).

Each line is judged on its own: too many symbols, shouting, navigation, boilerplate, missing end
punctuation. Failing lines go, and a document that loses too much of its text goes altogether.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import raw, struct_of

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
# Phrases of lines that belong to a site and not to its text.
BOILERPLATE = re.compile(
    rb"all rights reserved|privacy policy|cookie (?:policy|settings|preferences)|(?:use|uses|accept) cookies|terms (?:of use|of service|and conditions)"
    rb"|enable javascript|click here|subscribe (?:to|now)|sign (?:in|up) |log ?in to|copyright \(c\)|\xc2\xa9 ?\d{4}|powered by|lorem ipsum"
    rb"|share (?:this|on)|read more$|skip to (?:main )?content|^licensed under ", re.I)
# Marks between the entries of a menu, and marks that end a sentence.
SEPARATORS = re.compile(rb"\s(?:\||\xc2\xbb|\xc2\xb7|\xe2\x80\xa2|>|/)\s")
ENDS = tuple(".!?:;\"')]}…”’»。！？।؟")


@dataclass(frozen=True)
class LineRules:
    """Limits per line, and the part of a document's characters that may be lost."""

    symbol_share: float = 0.15
    upper_share: float = 0.6
    shout_words: int = 5
    separators: int = 3
    unended_words: int = 30
    lost_share: float = 0.5


def failing(line: bytes, rules: LineRules) -> str | None:
    """Name of the first rule that a line with a word fails."""
    words = line.split()
    size = len(line.translate(None, SPACE))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if len(SEPARATORS.findall(line)) >= rules.separators:
        return "navigation"
    if size > 8 and symbols > rules.symbol_share * size:
        return "symbols"
    if len(words) >= rules.shout_words:
        text = line.decode("utf-8", "replace")
        upper, lower = sum(map(str.isupper, text)), sum(map(str.islower, text))
        if upper > rules.upper_share * (upper + lower):
            return "shouting"
    if len(words) <= 40 and BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) >= 2 and len(words) < rules.unended_words and not line.rstrip().decode("utf-8", "replace").endswith(ENDS):
        return "unended"
    return None


def clean(text: bytes, rules: LineRules) -> tuple[bytes, int, int, Counter]:
    """The text without failing lines, its characters in words before and after, and the failures by rule."""
    kept, before, after, why = [], 0, 0, Counter()
    for line in text.split(b"\n"):
        bare = line.translate(None, SPACE)
        if not bare:
            kept.append(line)
            continue
        size = len(bare.translate(None, CONTINUED))
        before += size
        rule = failing(line, rules)
        if rule:
            why[rule] += 1
        else:
            kept.append(line)
            after += size
    return b"\n".join(kept), before, after, why


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == n:
        return 0
    count, total, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if count[window] > 1:
            total += at + width - max(at, end)
            end = at + width
    return total


def _measured(text: bytes, rules: LineRules) -> tuple:
    words = text.split()
    size = len(text.translate(None, SPACE + CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    _, before, after, why = clean(text, rules)
    kept = not failed and before - after <= rules.lost_share * before
    return len(words), size, symbols, len(lines) - len(set(lines)), repeated, failed, kept, sum(why.values()), after


def judge(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts and the verdict.

    NULL and empty texts have no words, so they fail. Repeated rows stay repeated.
    """
    kinds = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), pa.int64())
    kinds |= {"base_failed": pa.bool_(), "kept": pa.bool_(), "n_lines_removed": pa.int64(), "kept_chars": pa.int64()}

    @F.arrow_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
                 "n_lines_removed long, kept_chars long")
    def judged(column: pa.Array) -> pa.Array:
        rows = [_measured(t or b"", rules) for t in raw(column)]
        return struct_of({name: (kind, [r[k] for r in rows]) for k, (name, kind) in enumerate(kinds.items())})

    held = docs.select(F.col(id_col).alias("doc_id"), judged(F.col(text_col)).alias("found"))
    return held.select("doc_id", "found.*")


def cleaned(text: Column, rules: LineRules = LineRules()) -> Column:
    """The text without its failing lines, or NULL where the document is rejected."""
    @F.arrow_udf("string")
    def rewritten(column: pa.Array) -> pa.Array:
        out = []
        for text in raw(column):
            left, before, after, _ = clean(text or b"", rules)
            out.append(left if before and before - after <= rules.lost_share * before and not _measured(text, rules)[5] else None)
        return pa.array(out, pa.binary()).cast(pa.string())

    return rewritten(text)
