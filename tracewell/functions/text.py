"""Text expressions. Every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import patterns as P


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """Collapse any white space (no-break space included) to single blanks and trim."""
    return F.trim(F.regexp_replace(text_of(c), P.JAVA_WS + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_of(c), f"^{P.JAVA_WS}+|{P.JAVA_WS}+$", "")


def lexical_normalize(c: Column) -> Column:
    return clean(F.regexp_replace(F.lower(text_of(c)), "ㆍ", " "))


def lexical_words(c: Column) -> Column:
    """Words and grouped numbers of the normalised text.

    Normalising only changes white space and separators, which no token contains, so the
    lower-cased text is scanned directly.
    """
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(P.WORD), F.lit(0))


def bigrams(c: Column) -> Column:
    """``c2:xy`` for every adjacent letter pair; the zero-width match yields overlapping pairs."""
    pairs = F.regexp_extract_all(F.lower(text_of(c)), F.lit(P.LETTER_PAIR), F.lit(1))
    return F.transform(pairs, lambda x: F.concat(F.lit("c2:"), x))


def lexical_tokens(c: Column) -> Column:
    return F.concat(lexical_words(c), bigrams(c))


def consecutive_distinct(values: Column) -> Column:
    """Drop blanks, then every value equal to its predecessor. ``values`` must be a plain column."""
    return F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))


def clean_lines(c: Column) -> Column:
    """Cleaned, non-blank lines in order."""
    inline = F.regexp_replace(text_of(c), P.JAVA_WS_INLINE + "+", " ")
    return F.array_remove(F.split(F.trim(inline), " ?\n ?"), "")


def terms(c: Column, stop: Sequence[str] = P.STOP_TERMS, particles: Sequence[str] = P.PARTICLES) -> Column:
    """Distinct lower-case words of two letters and more, without particles and stop words."""
    found = F.lower(F.array_join(F.regexp_extract_all(text_of(c), F.lit(P.TERM), F.lit(0)), " "))
    if particles:
        longest_first = sorted(particles, key=len, reverse=True)
        tail = "|".join(longest_first)
        found = F.regexp_replace(found, f"(?<![^ ])([^ ]{{2,}}?)(?:{tail})(?![^ ])", "$1")
    values = F.array_distinct(F.array_remove(F.split(found, " "), ""))
    return F.array_except(values, F.array(*[F.lit(s) for s in stop])) if stop else values


def numeric_lexemes(c: Column) -> Column:
    bare = F.regexp_replace(text_of(c), P.CELL, "")
    return F.array_distinct(
        F.transform(F.regexp_extract_all(bare, F.lit(P.NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))
    )


def years(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(P.YEAR), F.lit(0))))


def set_cosine(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    scale = F.greatest(F.lit(1.0), F.sqrt((F.size(a) * F.size(b)).cast("double")))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / scale)


def citations(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(P.CITATION), F.lit(0)))


def visible_text(c: Column) -> Column:
    # What precedes a citation is none of its own characters, so nothing is gained by giving it back.
    bare = F.regexp_replace(text_of(c), rf"\[?+{P.JAVA_WS}*+(?:[Cc][Rr]|[Aa][Tt][Tt])_[a-fA-F0-9]{{20}}{P.JAVA_WS}*\]?", "")
    tidy = F.regexp_replace(bare, rf"{P.JAVA_WS}+([.,;:])", "$1")
    return strip(F.regexp_replace(tidy, r"[ \t]{2,}", " "))


def looks_complete(c: Column, suffixes: Sequence[str] = P.COMPLETE_SUFFIXES) -> Column:
    """Ends in a sentence mark or a closing verb form once citations are removed."""
    seen = clean(F.regexp_replace(text_of(c), P.CITATION, ""))
    return seen.rlike(r"(?:[.!?。]|" + "|".join(suffixes) + r")$")


def rollback_tail(c: Column) -> Column:
    """Cut an unfinished tail back to the last sentence mark, keeping citations right after it.

    Without any sentence mark the leading complete lines are kept, else the text stays.
    """
    text = F.regexp_replace(text_of(c), P.JAVA_WS + "+$", "")
    cite = rf"(?i)^(.*[.!?。](?:{P.JAVA_WS}*\[(?:CR|ATT)_[a-f0-9]{{20}}\])*)[^.!?。]*$".replace("(?i)", "(?is)")
    cut = F.regexp_replace(F.regexp_extract(text, cite, 1), P.JAVA_WS + "+$", "")
    lines = F.filter(
        F.transform(F.split(text, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"),
                    lambda x: F.regexp_replace(x, P.JAVA_WS + "+$", "")),
        lambda x: strip(x) != "",
    )
    # Position of the first unfinished line; without one every line is kept.
    flags = F.transform(lines, lambda x: looks_complete(x))
    first_bad = F.array_position(flags, F.lit(False)).cast("int")
    head = F.when(first_bad == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(first_bad - 1, F.lit(0))))
    joined = strip(F.array_join(head, "\n"))
    by_line = F.when(joined == "", text).otherwise(joined)
    return (
        F.when((text == "") | looks_complete(text), text)
        .when(text.rlike("[.!?。]"), cut)
        .otherwise(by_line)
    )


def let(value: Column, body) -> Column:
    """Bind a computed value once for use inside a nested lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def novel_continuation(base: Column, continuation: Column, longest: int = 240, shortest: int = 13) -> Column:
    """Drop from the continuation the longest prefix that already ends the base text."""
    value = strip(continuation)
    ends = F.struct(
        F.right(base, F.lit(longest)).alias("tail"), F.left(value, F.lit(longest)).alias("head"),
        F.least(F.lit(longest), F.length(base), F.length(value)).alias("limit"))
    sizes = F.sequence(F.lit(longest), F.lit(shortest), F.lit(-1))
    hit = let(ends, lambda e: F.get(F.filter(
        sizes, lambda n: (n <= e["limit"]) & (F.right(e["tail"], n) == F.left(e["head"], n))), 0))
    rest = F.when(F.startswith(value, base), F.substring(value, F.length(base) + 1, F.length(value))).otherwise(
        F.when(hit.isNotNull(), F.substring(value, hit + 1, F.length(value))))
    return F.when(rest.isNull(), value).otherwise(F.regexp_replace(rest, f"^{P.JAVA_WS}+", ""))


def strip_placeholders(c: Column) -> Column:
    """Drop lines that carry a style placeholder; if nothing is left drop only the placeholders."""
    text = text_of(c)
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(P.STYLE_PLACEHOLDER))
    cleaned = strip(F.array_join(kept, "\n"))
    return (
        F.when(~text.rlike(P.STYLE_PLACEHOLDER), strip(text))
        .when(cleaned != "", cleaned)
        .otherwise(strip(F.regexp_replace(text, P.STYLE_PLACEHOLDER, "")))
    )


def strip_scaffolding(c: Column) -> Column:
    """Remove an evidence-summary heading with its table and stray Markdown tables.

    After such a heading, blank and tabular lines are dropped until ordinary text returns. If
    nothing was removed or nothing would be left, the text stays.
    """
    value = strip(F.replace(F.replace(text_of(c), F.lit("```markdown"), F.lit("")), F.lit("```"), F.lit("")))

    def count(line: Column, piece: str) -> Column:
        return (F.length(line) - F.length(F.replace(line, F.lit(piece), F.lit("")))) / len(piece)

    def look(line: Column) -> Column:
        bare = strip(line)
        row, rule = bare.rlike(r"^\|.*\|$"), bare.rlike(rf"^\|?{P.JAVA_WS}*:?-{{3,}}")
        header = bare.rlike(rf"20\p{{Nd}}{{2}}[-./]?(?:0?[1-9]|1[0-2])|추정{P.JAVA_WS}*\p{{Nd}}*기") & (
            (count(line, "\t") > 0) | (count(line, "  ") >= 2))
        return F.struct(
            line.alias("line"), bare.rlike(rf"근거{P.JAVA_WS}*요약").alias("title"), (row | rule).alias("table"), (bare == "").alias("blank"),
            (header | (count(line, "\t") >= 2)).alias("columns"))

    def step(s: Column, x: Column) -> Column:
        hidden = x["title"] | (s["hide"] & (x["blank"] | x["table"] | x["columns"])) | x["table"]
        hide = F.when(x["title"], True).when(s["hide"] & ~x["blank"] & ~x["table"] & ~x["columns"], False).otherwise(s["hide"])
        return F.struct(F.when(hidden, s["kept"]).otherwise(F.array_append(s["kept"], x["line"])).alias("kept"),
                        hide.alias("hide"), (s["removed"] | hidden).alias("removed"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("hide"), F.lit(False).alias("removed"))
    end = F.aggregate(F.transform(F.split(value, "\n"), look), start, step)
    cleaned = strip(F.array_join(end["kept"], "\n"))
    return F.when(end["removed"] & (cleaned != ""), cleaned).otherwise(value)


def mask_style(c: Column, forbidden: Sequence[str] = (), *, target="특정대상", company="특정기업",
               day="특정일자", period="특정기간", value="수치") -> Column:
    """Replace forbidden tokens (longest first), companies, dates, years and numbers."""
    out = text_of(c)
    for token in sorted({t for t in forbidden if t}, key=lambda t: (-len(t), t)):
        out = F.replace(out, F.lit(token), F.lit(target))
    out = F.regexp_replace(out, P.COMPANY, company)
    out = F.regexp_replace(
        out, r"(?<!\p{Nd})(?:19|20)\p{Nd}{2}[./-]\p{Nd}{1,2}[./-]\p{Nd}{1,2}(?!\p{Nd})", day)
    out = F.regexp_replace(out, rf"(?<!\p{{Nd}})(?:19|20)\p{{Nd}}{{2}}{P.JAVA_WS}*년", period)
    return F.regexp_replace(out, P.NUMBER, value)


def expand_query(c: Column, dictionary: Mapping[str, Sequence[str]] = P.EXPANSIONS, label: str = P.EXPANSION_LABEL) -> Column:
    """Append the distinct concepts of every trigger that occurs in the query."""
    empty = F.array().cast("array<string>")
    parts = [
        F.when(F.contains(c, F.lit(t)), F.array(*[F.lit(v) for v in values])).otherwise(empty)
        for t, values in dictionary.items()
    ]
    added = F.array_distinct(F.flatten(F.array(*parts))) if parts else empty
    return F.when(F.size(added) == 0, c).otherwise(F.concat(c, F.lit(label), F.array_join(added, ", ")))


def any_marker(c: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(m)) for m in markers), F.lit(False))


def chat_intent(c: Column, opinion: Sequence[str] = P.OPINION_MARKERS, case: Sequence[str] = P.CASE_MARKERS) -> Column:
    value = clean(F.lower(text_of(c)))
    return (
        F.when(any_marker(value, opinion), "OPINION_QA").when(any_marker(value, case), "CASE_QA").otherwise("GENERAL")
    )


def content_type(c: Column) -> Column:
    compact = F.regexp_replace(c, "[, ]", "")
    return (
        F.when(compact == "", "empty")
        .when(compact.isin("-", "–", "—", "N/A", "n/a"), "missing")
        .when(compact.rlike(r"^[+-]?(?:\p{Nd}+(?:\.\p{Nd}+)?|\.\p{Nd}+)%?$"), "number")
        .otherwise("text")
    )


def escape_markdown(c: Column) -> Column:
    return F.replace(clean(c), F.lit("|"), F.lit("\\|"))


def content_hash(c: Column) -> Column:
    """Digest of the whole text, lower-cased and with single blanks."""
    return F.sha2(clean(F.lower(text_of(c))), 256)


def exact_hash(c: Column) -> Column:
    """Digest of the text as it is; an encoder tells apart what ``content_hash`` does not."""
    return F.sha2(text_of(c), 256)


def token_estimate(c: Column) -> Column:
    """Conservative token count, ceil(chars / 1.7); an empty text has none."""
    return F.ceil(F.length(text_of(c)) / F.lit(1.7)).cast("long")


def anchor(sentence: Column, number: Column, stop: Sequence[str] = P.ANCHOR_STOP, keep: int = 4) -> Column:
    """Last words before the first occurrence of a number."""
    at = F.instr(sentence, number)
    prefix = F.when(at > 0, F.substring(sentence, F.lit(1), at - 1)).otherwise(sentence)
    words = F.split(F.lower(F.array_join(F.regexp_extract_all(prefix, F.lit(P.TERM), F.lit(0)), " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*stop)) if stop else F.array_remove(words, "")
    return F.slice(kept, F.greatest(F.size(kept) - keep + 1, F.lit(1)), F.lit(keep))


def canonical_number(c: Column) -> Column:
    """Plain decimal notation: no separators, sign kept, no useless zeros, no negative zero."""
    bare = F.regexp_replace(c, ",", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"^(-?)0+(?=\p{Nd})", "$1")
    trimmed = F.when(F.contains(whole, F.lit(".")), F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", "")).otherwise(whole)
    return F.when(trimmed.isin("-0", ""), "0").otherwise(trimmed)


def sentences_naive(c: Column) -> Column:
    """Pieces up to the next run of . ! ? or line end; citation-only pieces stay separate here."""
    pieces = F.regexp_extract_all(text_of(c), F.lit(r"[^.!?\n]+(?:[.!?]+|$)|\n+"), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def claim_sentences(c: Column) -> Column:
    """Sentences for claims: a dot between digits does not end one, a line feed always does."""
    guarded = F.regexp_replace(text_of(c), r"(?<=\p{Nd})\.(?=\p{Nd})", "￾")
    pieces = F.regexp_extract_all(guarded, F.lit(r"[^.!?\n]*[.!?]+|[^.!?\n]+"), F.lit(0))
    restored = F.transform(pieces, lambda x: F.translate(x, "￾", "."))
    return F.filter(restored, lambda x: strip(x) != "")
