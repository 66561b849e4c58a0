"""Secrets in texts: fixed patterns, and values of credential fields that are costly to guess (operator 1).

A value in a credential context (a field, an authorization header, the password of a URL) is cut into
dictionary words, dates, repeats, keyboard walks and brute-force spans so that the product of the
guesses is smallest; a value whose cheapest cut still needs many guesses is a secret. The dictionary
is the most frequent words of the corpus itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import raw, struct_of

# The three base patterns, with letters in either case for the first.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

# Names of fields that hold credentials, beyond those of the first pattern, and schemes before a value.
# A quoted value goes to its closing quote, any other to the next blank or delimiter.
CONTEXT = re.compile(
    rb"""(?<![a-z0-9])(?:[a-z0-9]{1,20}[_-])?(?:password|passphrase|passcode|passwd|pass|pwd|secret|token|bearer|credentials?|auth|authorization|private[_-]?key"""
    rb"""|access[_-]?key|api[_-]?key|client[_-]?secret|login|pin)(?![a-z0-9])["']?\s{0,4}(?:[:=]>?|\x20is\x20)\s{0,4}(?:(?:bearer|basic|token)\x20+)?"""
    rb"""(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|`([^`\r\n]{6,})`|["'`]?([^\s"'`<>,;]{6,}))""", re.I)
URL = re.compile(rb"[a-z][a-z0-9+.-]*://", re.I)
URL_PASSWORD = re.compile(rb"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s/@:\"'<>]{0,200}:([^\s/@\"'<>]{6,})@", re.I)

# Frequent words of guessed passwords, the most frequent first.
WORDS = """password the and admin welcome login master dragon monkey letmein sunshine princess football baseball secret
shadow michael jordan superman batman trustno hello freedom whatever charlie love iloveyou test guest root user pass
changeme default summer winter spring autumn monday friday january march april june july august october november
december example sample token server access computer internet service company private public system network""".split()
# Rows of a keyboard.
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@431!05$7", "aaeiiosst")
BRUTE = math.log10(10)
#: A repeat, walk or sequence may begin or end this far from where it could at most; a shorter one anywhere.
SLACK = 24
UNIT = 12
LEARNED_WORDS = 20_000
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d")


@dataclass(frozen=True)
class GuessCosts:
    """Costs in powers of ten. ``threshold``: a value this costly is a secret."""

    threshold: float = 10.0
    join: float = 0.3
    words: dict = field(default_factory=lambda: {w: math.log10(k + 2) for k, w in enumerate(WORDS)}, hash=False)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.words), default=0)


def _beside() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEYS):
        for c, key in enumerate(row):
            for dr, dc in ((0, -1), (0, 1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
                if 0 <= r + dr < len(KEYS) and 0 <= c + dc < len(KEYS[r + dr]):
                    near.setdefault(key, set()).add(KEYS[r + dr][c + dc])
    return near


BESIDE = _beside()


def learned(docs: DataFrame, text_col: str = "text", most: int = LEARNED_WORDS, least: int = 3) -> GuessCosts:
    """Costs whose dictionary is the corpus' ``most`` frequent words of 3 to 24 letters that occur ``least`` times or more.

    The fixed words come first, then those of the corpus by falling count, ties in order of the
    alphabet; a word costs the logarithm of its place. All documents are counted; the bounded list
    comes to the driver and goes to the tasks. Without texts only the fixed words are left. A password
    of letters alone that the corpus repeats more often than its rarest listed word counts as a word.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?<!\p{L})(\p{L}{3,24})(?!\p{L})"), 1)).alias("word"))
    top = words.groupBy("word").count().where(F.col("count") >= least).orderBy(F.desc("count"), "word").limit(most).collect()
    own = dict.fromkeys([*WORDS, *(r.word for r in top)])
    return GuessCosts(words={w: math.log10(k + 2) for k, w in enumerate(own)})


def _edges(start: int, end: int, step: int = 1) -> list[tuple[int, int]]:
    """Parts of a run (at least 3 long, by ``step``): all of a short one, of a long one those near its edges.

    So their number grows with the number of runs, not with the square of a run's length.
    """
    starts = range(start, min(end - 2, start + SLACK))
    found = []
    for i in starts:
        times = (end - i) // step
        ends = range(1, times + 1) if times <= 2 * SLACK else [*range(1, SLACK + 1), *range(times - SLACK, times + 1)]
        found += [(i, i + t * step) for t in ends if t * step >= 3 and (step == 1 or t > 1)]
    if end - start > SLACK + 2:
        found += [(i, end) for i in range(max(start + SLACK, end - SLACK), end - 2) if (end - i) % step == 0 and end - i > step]
    return found


def _runs(n: int, follows) -> list[tuple[int, int]]:
    """Longest (start, end) of which each place from the second on follows the one before."""
    found, start = [], 0
    for j in range(1, n + 1):
        if j == n or not follows(j):
            if j - start >= 3:
                found.append((start, j))
            start = j
    return found


def spans_of(value: str, costs: GuessCosts) -> list[tuple[int, int, float]]:
    """Parts of a value that are cheaper than brute force: (start, end, log10 of the guesses); linear in its length."""
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    found = [(m.start(), m.end(), math.log10(365 * 120 if m.end() - m.start() > 4 else 120)) for k in range(n) if (m := DATE.match(value, k))]
    longest = costs.longest
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            cost = costs.words.get(low[i:j])
            leet = costs.words.get(plain[i:j])
            if cost is not None or leet is not None:
                part = value[i:j]
                case = 0.0 if part == part.lower() else math.log10(2) if part in (part.upper(), part.capitalize()) else len(part) * math.log10(2)
                found.append((i, j, min(x for x in (cost, None if leet is None else leet + math.log10(4)) if x is not None) + case))
    for size in range(1, UNIT + 1):
        start = None
        for k in range(size, n + 1):
            if k < n and value[k] == value[k - size]:
                start = k - size if start is None else start
            elif start is not None:
                if k - start >= 2 * size:
                    found += [(i, j, size * BRUTE + math.log10((j - i) // size)) for i, j in _edges(start, k, size)]
                start = None
    for start, end in _runs(n, lambda j: low[j] in BESIDE.get(low[j - 1], ())):
        found += [(i, j, math.log10(47 * 2) + math.log10(j - i) + 0.5 * (j - i)) for i, j in _edges(start, end)]
    for start, end in _runs(n, lambda j: abs(ord(low[j]) - ord(low[j - 1])) == 1 and low[j - 1].isalnum() and low[j].isalnum()):
        turns = [0, 0]
        for j in range(start + 2, end):
            turns.append(turns[-1] + (ord(low[j]) - ord(low[j - 1]) != ord(low[j - 1]) - ord(low[j - 2])))
        found += [(i, j, math.log10(36) + math.log10(j - i) + turns[j - 1 - start] - turns[i + 1 - start]) for i, j in _edges(start, end)]
    return found


def guess_cost(value: str, costs: GuessCosts = GuessCosts()) -> float:
    """log10 of the guesses for the cheapest cut of a value of any length."""
    n = len(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in spans_of(value, costs):
        ending.setdefault(end, []).append((start, cost))
    # Cheapest cut of the first i characters, the last part brute force or not.
    named, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    named[0] = 0.0
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], named[j - 1] + (costs.join if j > 1 else 0)) + BRUTE
        for i, cost in ending.get(j, ()):
            named[j] = min(named[j], min(named[i], brute[i]) + cost + (costs.join if i else 0))
    return min(named[n], brute[n])


def find(text: bytes, costs: GuessCosts = GuessCosts()) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in bytes, by start and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base, values = sorted((start, end) for start, end, _ in found), []
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        quoted = m.lastindex < 4
        while not quoted and end > start and text[end - 1:end] in (b".", b")", b"]", b"}", b"!", b"?", b":"):
            end -= 1
        # A URL in such a field is no secret, a password in it is found below.
        if not URL.match(text, start, end):
            values.append((start, end))
    values += [m.span(1) for m in URL_PASSWORD.finditer(text)]
    for start, end in sorted(set(values)):
        value = text[start:end].decode("utf-8", "replace")
        # A value within a base span is found already; one that reaches beyond it counts as a whole.
        if end - start >= 6 and not any(a <= start and end <= b for a, b in base) and guess_cost(value, costs) >= costs.threshold:
            found.append((start, end, "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def in_characters(text: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same spans counted in code points."""
    if not found or text.isascii():
        return found
    place, at, seen = {}, 0, 0
    for edge in sorted({e for start, end, _ in found for e in (start, end)}):
        seen += len(text[at:edge].decode("utf-8"))
        place[edge] = seen
        at = edge
    return [(place[start], place[end], kind) for start, end, kind in found]


def _told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def secret_spans(text: Column, costs: GuessCosts = GuessCosts()) -> Column:
    """Array of spans (kind, start, end) in code points; empty for NULL and empty texts."""
    @F.arrow_udf("array<struct<kind string, start long, end long>>")
    def spans(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in in_characters(t, find(t, costs))] if t else []
                         for t in raw(column)], kind)

    return spans(text)


def masked(text: Column, costs: GuessCosts = GuessCosts(), mark: str = "[SECRET]") -> Column:
    """The text with every secret (overlapping ones together) replaced by ``mark``; NULL stays NULL."""
    @F.arrow_udf("string")
    def hidden(column: pa.Array) -> pa.Array:
        out = []
        for text in raw(column):
            found = find(text, costs) if text else []
            if not found:
                out.append(text)
                continue
            parts, at = [], 0
            for start, end, _ in found:
                if start >= at:
                    parts += [text[at:start], mark.encode()]
                at = max(at, end)
            out.append(b"".join([*parts, text[at:]]))
        return pa.array(out, pa.binary()).cast(pa.string())

    return hidden(text)


def scan(docs: DataFrame, costs: GuessCosts = GuessCosts(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the number of each kind of span and digests of them.

    NULL and empty texts have no span, so the digest of an empty string. Where spans of one kind
    start together there is only one; different kinds may overlap and all stay.
    """
    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
    def told(column: pa.Array) -> pa.Array:
        rows = [in_characters(t, find(t, costs)) if t else [] for t in raw(column)]
        number = {k: [sum(s[2] == k for s in own) for own in rows] for k in KINDS}
        return struct_of({
            "n_assign": (pa.int64(), number["assign"]), "n_access": (pa.int64(), number["access"]), "n_hex": (pa.int64(), number["hex"]),
            "base_sha256": (pa.string(), [hashlib.sha256(_told([s for s in own if s[2] != "guess"]).encode()).hexdigest() for own in rows]),
            "spans": (pa.string(), [_told(own) for own in rows]), "n_guess": (pa.int64(), number["guess"])})

    held = docs.select(F.col(id_col).alias("doc_id"), told(F.col(text_col)).alias("found"))
    return held.select("doc_id", "found.*")
