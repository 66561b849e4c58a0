"""Groups of spelling variants through pivotal grams (operator 13).

The positional bigrams of a word are ordered by how rare they are in the vocabulary. Its prefix is the
three rarest, with all that share the third one's bigram; its pivots are two of the prefix that do not
overlap, chosen by dynamic programming to be the rarest pair. One edit destroys at most one of two
disjoint bigrams. So of two words one edit apart, the one whose prefix ends earlier in the order has a
pivot that lives on in the other's prefix - at the same distance from the start (before the edit) or
from the end (after it). Such meetings are joined and verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import LOWER, batch_of, prepare
from tracewell.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MODULUS = 97
LETTERS = 5
OCCURRENCES = 3
GROWTH = 2
PREFIX = 3
#: Distinct words that a task counts before it hands them on, and remembered spellings.
HELD = 200_000
#: Longer texts are read match by match.
LONG = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch], modulus: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    lowered: dict[str, tuple[str, bytes]] = {}

    def handed() -> pa.RecordBatch:
        return batch_of({"word": (pa.string(), list(held)), "n": (pa.int64(), list(held.values()))})

    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            start = zlib.crc32(f"{'' if own is None else own}:".encode())
            runs = Counter(RUN.findall(text) if len(text) < LONG else (m.group() for m in RUN.finditer(text)))
            for run, n in runs.items():
                found = lowered.get(run)
                if found is None:
                    if len(lowered) >= HELD:
                        lowered.clear()
                    raw = run.encode().translate(LOWER)
                    found = lowered[run] = raw.decode(), raw
                word, raw = found
                h = zlib.crc32(raw, start)
                if h % modulus == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                held[word] += n
            if len(held) >= HELD:
                yield handed()
                held.clear()
    if held:
        yield handed()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, modulus: int = MODULUS) -> DataFrame:
    """Rows (word, n) of at least ``letters`` code points that occur at least ``occurrences`` times in all texts.

    A word is a run of letters, A-Z in lower case; from one in ``modulus`` (document, run) a letter is
    deleted, as told by crc32 of ``<id>:<run>`` (an empty id if NULL). NULL texts have none.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    counted = texts.mapInArrow(lambda batches: _counted(batches, modulus), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.char_length("word") >= letters) & (F.col("n") >= occurrences))


def prefix_of(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(order of the bigram, position) of the rarest bigrams, in the order of positions."""
    grams = [(order[word[k:k + 2]], k) for k in range(len(word) - 1)]
    last = sorted(grams)[:PREFIX][-1][0]
    return [g for g in grams if g[0] <= last]


def pivots_of(prefix: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The two disjoint bigrams of the least sum of orders: the best first one up to each position, then each as second."""
    best, first, ends = None, None, 0
    for own in prefix:
        while ends < len(prefix) and prefix[ends][1] + 2 <= own[1]:
            first = min(first or prefix[ends], prefix[ends])
            ends += 1
        if first and (best is None or first[0] + own[0] < best[0]):
            best = first[0] + own[0], [first, own]
    return best[1] if best else []


START, END = 0, 1
KEPT, ASKS = 0, 1
#: Rows and meetings that a task looks at in one go.
ROWS = 1 << 14
MEETINGS = 1 << 20
#: Words up to this length are compared in one matrix.
SHORT = 48

KEYED = "key long, kind int, word string, letters long, last int"


def _keyed(batches: Iterator[pa.RecordBatch], order: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """One row for each key under which a word is kept (prefix) or asked for (pivots)."""
    def key(gram: int, side: int, place: int, size: int) -> int:
        return (gram << 1 | side) << 42 | (place & 0x1FFFFF) << 21 | size & 0x1FFFFF

    for batch in batches:
        keys, kinds, owner, letters, lasts = [], [], [], [], []
        for number, word in enumerate(batch.column(0).to_pylist()):
            size, prefix = len(word), prefix_of(word, order)
            mask = 0
            for c in word:
                mask |= 1 << (ord(c) * 7 & 63)
            letters.append(mask - ((mask >> 63) << 64))
            lasts.append(max(g for g, _ in prefix))
            own = [key(gram, side, place, size) for gram, at in prefix for side, place in ((START, at), (END, size - at))]
            kinds += [KEPT] * len(own)
            # Of equal length, a bigram that lives on stays at its place; else it keeps its distance from the start or the end.
            asked = [key(gram, side, place, other) for gram, at in pivots_of(prefix) for side, place, other in (
                (START, at, size), (START, at, size + 1), (START, at, size - 1), (END, size - at, size + 1), (END, size - at, size - 1))]
            kinds += [ASKS] * len(asked)
            keys += own + asked
            owner += [number] * (len(own) + len(asked))
        taken = pa.array(owner, pa.int64())
        yield batch_of({"key": (pa.int64(), keys), "kind": (pa.int32(), kinds), "word": (pa.string(), batch.column(0).take(taken)),
                        "letters": (pa.int64(), pa.array(letters, pa.int64()).take(taken)), "last": (pa.int32(), pa.array(lasts, pa.int32()).take(taken))})


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one edit: what they share at the start and at the end makes up all but one."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    ending = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    return shared + ending >= max(len(a), len(b)) - 1


def _codes(words: list[str], size: np.ndarray, right: bool) -> np.ndarray:
    """Code points as a matrix, read from the left or from the right; words beyond ``SHORT`` are left out."""
    out = np.zeros((len(words), SHORT), np.uint32)
    short = size <= SHORT
    flat = np.frombuffer("".join(w for w, s in zip(words, short.tolist()) if s).encode("utf-32-le"), "<u4")
    sizes = np.where(short, size, 0)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat[np.repeat(np.cumsum(sizes), sizes) - 1 - place] if right else flat
    return out


def _near(words: list[str], size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) of row numbers are one edit apart."""
    good = np.zeros(len(x), bool)
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    own = [words[k] for k in used.tolist()]
    left, right = _codes(own, size[used], False), _codes(own, size[used], True)
    u, v = at[:len(x)], at[len(x):]
    longer = np.maximum(size[x], size[y])
    short = np.flatnonzero(longer <= SHORT)
    for part in np.array_split(short, -(-len(short) // (1 << 16)) or 1):
        # Beyond both words all is equal, so the shared parts are bounded by the shorter word.
        fewer = np.minimum(size[x[part]], size[y[part]])
        start, end = ((m[u[part]] != m[v[part]]) for m in (left, right))
        shared = np.minimum(np.where(start.any(axis=1), start.argmax(axis=1), SHORT), fewer)
        ending = np.minimum(np.where(end.any(axis=1), end.argmax(axis=1), SHORT), fewer)
        differ = start.any(axis=1) | (size[x[part]] != size[y[part]])
        good[part] = differ & (np.abs(size[x[part]] - size[y[part]]) <= 1) & (shared + ending >= longer[part] - 1)
    for k in np.flatnonzero(longer > SHORT).tolist():
        good[k] = one_edit(words[x[k]], words[y[k]])
    return good


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and kind: the near pairs among those that meet under a key.

    A task holds ``ROWS`` rows or those of one key, which are words of one length that share a rare bigram at one place.
    """
    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, kind, last = (rows.column(c).to_numpy() for c in ("key", "kind", "last"))
        letters = rows.column("letters").to_numpy().view(np.uint64)
        words = rows.column("word").to_pylist()
        size = np.fromiter(map(len, words), np.int64, len(words))
        kept, asks = np.flatnonzero(kind == KEPT), np.flatnonzero(kind == ASKS)
        begin = np.searchsorted(key[kept], key[asks], "left")
        number = np.searchsorted(key[kept], key[asks], "right") - begin
        ends = np.cumsum(number)
        at = 0
        while at < len(asks):
            # At least one asking row, with all its meetings.
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - number[at] + MEETINGS, "right")))
            n = number[at:stop]
            x = np.repeat(asks[at:stop], n)
            y = kept[np.repeat(begin[at:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = stop
            # The prefix of the pivot's word ends first; one edit changes at most two letters.
            open_ = np.flatnonzero(np.bitwise_count(letters[x] ^ letters[y]) <= 2)
            open_ = open_[last[x[open_]] <= last[y[open_]]]
            x, y = x[open_], y[open_]
            if len(x):
                good = np.flatnonzero(_near(words, size, x, y))
                own = rows.column("word").combine_chunks() if isinstance(rows.column("word"), pa.ChunkedArray) else rows.column("word")
                yield batch_of({"a": (pa.string(), own.take(pa.array(x[good]))), "b": (pa.string(), own.take(pa.array(y[good])))})

    held: list[pa.RecordBatch] = []
    number = 0
    for batch in batches:
        held.append(batch)
        number += batch.num_rows
        if number < ROWS or not batch.num_rows:
            continue
        rows = pa.Table.from_batches(held)
        cut = int(np.searchsorted(rows.column("key").to_numpy(), rows.column("key")[-1].as_py(), "left"))
        if cut:
            yield from pairs(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).combine_chunks().to_batches()
            number = rows.num_rows - cut
    if number:
        yield from pairs(pa.Table.from_batches(held).combine_chunks())


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b), both ways round, of ``word`` rows that differ by exactly one inserted, deleted or replaced code point.

    Words are distinct and have at least five code points.
    """
    prepare(words.sparkSession)
    bigrams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda k: F.substring("word", k, F.lit(2)))).alias("gram"))
    # At most one number for each pair of the 90 letters.
    order = {r.gram: k for k, r in enumerate(sorted(bigrams.groupBy("gram").count().collect(), key=lambda r: (r["count"], r.gram)))}
    keyed = words.select("word").mapInArrow(lambda batches: _keyed(batches, order), KEYED)
    met = keyed.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_met, "a string, b string")
    once = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for rows (word, form) without a cycle: the end of each word's chain, by pointer jumping."""
    held = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not held.where("open").isEmpty():
        further = held.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = held.join(further, F.col("root") == F.col("at"), "left")
        held = cut_lineage(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
    return held.select("word", "root")


def variants(words: DataFrame, growth: int = GROWTH) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for distinct words (word, n).

    ``form`` is the near word of largest n, ties the smallest, if that n is at least ``growth`` (over one) times
    the word's; ``root`` the end of the chain of forms, the word itself without one. An empty vocabulary gives no rows.
    """
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("near_n"))
    near = near_pairs(words).join(counts, "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("b").alias("word"))).alias("top"))
    joined = words.join(near, F.col("word") == F.col("a"), "left")
    good = -F.col("top.n") >= growth * F.col("n")
    held = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(good, F.col("top.word")).alias("form"), F.when(good, -F.col("top.n")).alias("form_n")))
    ends = roots(held.where("form IS NOT NULL"))
    return held.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of all texts; repeated rows count as often as they occur, other columns are ignored."""
    return variants(cut_lineage(vocabulary(docs)))
