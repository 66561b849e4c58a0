"""Language identification with bit-sliced Bloom filters of n-grams (operator 7).

Every position of the filter holds one bit per language, in one word for each 64 of them. The AND of the words at an n-gram's
positions is the set of languages whose filter contains it. A text's bits are counted per
language, the expected false positives are taken off, and the best language wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import batch_of, pieces, raw, struct_of

WIDTH = 4
PIECE = 1 << 18
KEEP_GRAMS = 1 << 21
# Odd multipliers of the hash functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

#: ASCII letters lower-cased, other ASCII bytes to space, everything else kept.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class LanguageFilter:
    """``bits``: one row of words for each 64 languages."""

    languages: list[str]
    bits: np.ndarray
    false_rate: np.ndarray


def _folded(text: bytes | None) -> bytes:
    """Lower case with a space around each word; case folding beyond ASCII needs the text itself."""
    if not text:
        return b""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    return b" " + text.translate(LETTERS) + b" "


def _grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all parts as numbers, and how many belong to each part.

    An n-gram may hold a space at either end, never inside, and never lies across two parts.
    """
    joined = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    n = len(joined) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
    value = np.zeros(n, np.uint32)
    good = np.ones(n, bool)
    blank, cut = joined == 32, joined == 10
    for k in range(WIDTH):
        value = (value << np.uint32(8)) | joined[k:n + k]
        good &= ~cut[k:n + k]
        if 0 < k < WIDTH - 1:
            good &= ~blank[k:n + k]
    before = np.concatenate([[0], np.cumsum(good)])
    edges = np.minimum(np.append(starts, len(joined)), n)
    return value[good], np.diff(before[edges])


def _positions(grams: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - (size.bit_length() - 1))
    wide = grams.astype(np.uint64)
    for multiplier in MULTIPLIERS[:hashes]:
        yield ((wide * np.uint64(multiplier)) >> shift).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language the count of each n-gram, given out whenever the table is large."""
    kind = {"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}

    def give(lang: str, held: list) -> pa.RecordBatch:
        grams = np.concatenate([g for g, _ in held])
        order, index = np.unique(grams, return_inverse=True)
        n = np.bincount(index, np.concatenate([c for _, c in held])).astype(np.int64)
        return batch_of({"lang": (kind["lang"], [lang] * len(order)), "gram": (kind["gram"], order.astype(np.int64)), "n": (kind["n"], n)})

    held: dict[str, list] = {}
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            for _, parts in pieces(map(_folded, own), PIECE, WIDTH - 1):
                grams, n = np.unique(_grams(parts)[0], return_counts=True)
                mine = held.setdefault(lang, [])
                mine.append((grams, n))
                if len(mine) >= 8:
                    whole = give(lang, mine)
                    if whole.num_rows > KEEP_GRAMS // max(1, len(held)):
                        yield whole
                        held[lang] = []
                    else:
                        held[lang] = [(whole.column(1).to_numpy().astype(np.uint32), whole.column(2).to_numpy())]
    for lang, mine in held.items():
        if mine:
            yield give(lang, mine)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = 1 << 19, hashes: int = 3,
        share: float = 0.3, least: int = 3) -> LanguageFilter:
    """Learn the filters from all labelled rows; rows without text or language teach nothing.

    A language's filter takes an n-gram seen ``least`` times whose rate is at least ``share`` of the
    highest rate in any language. What reaches the driver is the name and total of each
    language and at most one word for each of the ``size`` positions and 64 languages.
    """
    held = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = held.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    groups = -(-len(languages) // 64)
    if not languages:
        return LanguageFilter([], np.zeros((0, size), np.uint64), np.zeros(0))
    # A bit by its place among 64, as a signed long.
    numbered = labelled.sparkSession.createDataFrame(
        [(lang, float(totals[lang]), k // 64, (1 << k % 64) - (1 << 64 if k % 64 == 63 else 0)) for k, lang in enumerate(languages)],
        "lang string, total double, word int, bit long")
    each = counts.join(F.broadcast(numbered), "lang").select("gram", "word", "bit", "n", (F.col("n") / F.col("total")).alias("rate"))
    wide = each.groupBy("gram").agg(F.collect_list(F.struct("word", "bit", "n", "rate")).alias("own"), F.max("rate").alias("top"))
    taken = wide.withColumn("own", F.filter("own", lambda x: (x.n >= least) & (x.rate >= share * F.col("top")))).where(F.size("own") > 0)
    words = F.transform(F.array_distinct(F.transform("own", lambda x: x.word)), lambda w: F.struct(w.alias("word"), F.aggregate(
        F.filter("own", lambda x: x.word == w), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x.bit)).alias("mask")))
    mask = taken.select("gram", F.explode(words).alias("word")).select("gram", "word.word", "word.mask")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy()
            for at in _positions(grams, size, hashes):
                yield batch_of({"at": (pa.int64(), at), "word": (pa.int32(), batch.column(1)), "mask": (pa.int64(), batch.column(2))})

    bits = np.zeros((groups, size), np.uint64)
    found = mask.mapInArrow(placed, "at long, word int, mask long").groupBy("at", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits[found.column("word").to_numpy(), found.column("at").to_numpy()] = found.column("mask").to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([np.mean((bits[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))])
    narrow = next(t for t, width in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(languages), 64) <= width)
    return LanguageFilter(languages, bits.astype(narrow), fill ** hashes)


def tallies(model: LanguageFilter, texts: list[bytes], hashes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams of each text, and how many of them each language's filter contains."""
    n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(model.languages)))
    one = model.bits.dtype.type(1)
    for rows, parts in pieces(map(_folded, texts), PIECE, WIDTH - 1):
        grams, sizes = _grams(parts)
        np.add.at(n, rows, sizes)
        edges = np.append(0, np.cumsum(sizes))
        places = list(_positions(grams, model.bits.shape[1], hashes))
        for first, words in zip(range(0, len(model.languages), 64), model.bits):
            mask = None
            for at in places:
                word = words[at]
                mask = word if mask is None else mask & word
            for k in range(min(64, len(model.languages) - first)):
                before = np.append(0, np.cumsum((mask >> model.bits.dtype.type(k)) & one, dtype=np.int64))
                np.add.at(hits[:, first + k], rows, np.diff(before[edges]))
    return n, hits


def predict(text: Column, model: LanguageFilter, hashes: int = 3) -> Column:
    """Struct (lang, score, held) of a text.

    ``und`` with score 0 for NULL and for texts without a letter; ties go to the first language by
    name. The score is the best language's part of all corrected counts; ``held`` is the part of the text's n-grams that its filter contains,
    corrected as well, which close languages do not lower.
    """
    @F.arrow_udf("lang string, score double, held double")
    def predicted(column: pa.Array) -> pa.Array:
        texts = raw(column)
        n, hits = tallies(model, texts, hashes)
        fair = np.maximum(hits - n[:, None] * model.false_rate, 0) / np.maximum(1 - model.false_rate, 1e-9)
        langs, scores, held = [], [], []
        for text, own, grams in zip(texts, fair, n):
            letters = bool(text) and (any(map(str.isalpha, text[:200].decode("utf-8", "ignore"))) or any(map(str.isalpha, text.decode("utf-8", "replace"))))
            if not letters or not len(own):
                langs.append("und")
                scores.append(0.0)
                held.append(0.0)
                continue
            best, whole = int(np.argmax(own)), float(own.sum())
            langs.append(model.languages[best])
            scores.append(float(own[best]) / whole if whole > 0 else 0.0)
            held.append(float(own[best]) / grams if grams > 0 else 0.0)
        return struct_of({"lang": (pa.string(), langs), "score": (pa.float64(), scores), "held": (pa.float64(), held)})

    # Not deterministic for the optimizer: a filter on the result must not evaluate it a second time.
    return predicted.asNondeterministic()(text)
