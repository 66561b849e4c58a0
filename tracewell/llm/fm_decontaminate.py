"""Benchmark decontamination with an FM-index per shard of documents (operator 5).

The documents of a shard become one sequence of word numbers. Windows of the benchmark items are
found by backward search, located through sampled suffixes and merged into spans of words.
Words that no item has can be in no window, so they share one number and their runs are indexed as
one symbol. Items are searched in blocks of bounded size; a block's windows go to every task.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import raw
from tracewell.llm.fm_index import MOST, FmIndex

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Words of an index; an index over more takes more memory and finds the same.
SHARD = MOST // 2 - 2
LOCATE_ROWS = 1 << 18
#: ASCII letters lower-cased, digits and bytes from 128 kept, all else to space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OTHER = 1
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
KIND = pa.struct([("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
KIND_SQL = "n_words long, spans array<struct<start long, end long>>, items array<string>"


@dataclass
class Phrases:
    """Windows of a block of items as padded rows of word numbers, and the items of each."""

    numbers: dict[bytes, int]
    windows: np.ndarray
    sizes: np.ndarray
    owner_from: np.ndarray
    owners: np.ndarray
    items: list[str]

    @property
    def bits(self) -> int:
        return max(2, (len(self.numbers) + 2).bit_length())


def phrases(rows: list[tuple[str, bytes]], width: int = WINDOW) -> Phrases:
    numbers: dict[bytes, int] = {}
    items = sorted({name for name, _ in rows})
    place = {name: k for k, name in enumerate(items)}
    found: dict[tuple, set[int]] = {}
    for name, text in rows:
        own = [numbers.setdefault(w, len(numbers) + OTHER + 1) for w in text.translate(WORDS).split()]
        for k in range(max(1, len(own) - width + 1) if own else 0):
            found.setdefault(tuple(own[k:k + width]), set()).add(place[name])
    windows = np.full((len(found), width), -1, np.int64)
    for row, window in enumerate(found):
        windows[row, width - len(window):] = window
    owners = [sorted(own) for own in found.values()]
    return Phrases(numbers, windows, (windows >= 0).sum(axis=1), np.append(0, np.cumsum([len(o) for o in owners])).astype(np.int64),
                   np.array([x for o in owners for x in o], np.int64), items)


def _search(held: Phrases, parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hit words of each part, and the distinct pairs (part, item)."""
    sizes = np.array([len(p) + 1 for p in parts])
    starts = np.cumsum(sizes) - sizes
    words = np.full(int(sizes.sum()), OTHER, np.int64)
    for start, part in zip(starts, parts):
        words[start:start + len(part)] = part
    kept = words > OTHER
    kept[1:] |= words[:-1] > OTHER
    place = np.flatnonzero(kept)
    edges, pairs = np.zeros(len(words) + 1, np.int64), [np.zeros((0, 2), np.int64)]
    if len(place):
        index = FmIndex(words[place], held.bits)
        low, high = index.ranges(held.windows)
        number = np.maximum(high - low, 0)
        ends = np.cumsum(number)
        for at in range(0, int(ends[-1]) if len(ends) else 0, LOCATE_ROWS):
            hit = np.arange(at, min(at + LOCATE_ROWS, int(ends[-1])))
            window = np.searchsorted(ends, hit, "right")
            start = place[index.locate(low[window] + hit - (ends - number)[window])]
            np.add.at(edges, start, 1)
            np.add.at(edges, start + held.sizes[window], -1)
            part = np.searchsorted(starts, start, "right") - 1
            several = held.owner_from[window + 1] - held.owner_from[window]
            owner = held.owners[np.repeat(held.owner_from[window] - (np.cumsum(several) - several), several) + np.arange(several.sum())]
            pairs.append(np.unique(np.stack([np.repeat(part, several), owner], axis=1), axis=0))
    hit = np.cumsum(edges) > 0
    return [hit[s:s + len(p)] for s, p in zip(starts, parts)], np.unique(np.concatenate(pairs), axis=0)


def mark(texts: list[bytes | None], held: Phrases, shard: int = SHARD) -> list[dict]:
    """Number of words, merged hit spans (of word numbers) and items of each text."""
    out = [{"n_words": 0, "spans": [], "items": []} for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []
    hits: dict[int, np.ndarray] = {}
    names: dict[int, set[str]] = {}
    overlap = held.windows.shape[1] - 1
    load = 0

    def flush() -> None:
        nonlocal load
        if not waiting:
            return
        found, pairs = _search(held, [part for _, _, part in waiting])
        for (row, at, part), own in zip(waiting, found):
            if own.any():
                whole = hits.setdefault(row, np.zeros(out[row]["n_words"], bool))
                whole[at:at + len(part)] |= own
        for k, item in pairs:
            names.setdefault(waiting[k][0], set()).add(held.items[item])
        waiting.clear()
        load = 0

    for row, text in enumerate(texts):
        words = text.translate(WORDS).split() if text else []
        out[row]["n_words"] = len(words)
        own = np.fromiter(map(held.numbers.get, words, repeat(OTHER)), np.int64, len(words))
        del words
        if not (own > OTHER).any():
            continue
        for at in range(0, max(1, len(own) - overlap), shard - 1 - overlap):
            part = own[at:at + shard - 1]
            cost = min(len(part) + 1, 2 * int((part > OTHER).sum()) + 1)
            if load + cost > shard:
                flush()
            waiting.append((row, at, part))
            load += cost
    flush()
    for row, hit in hits.items():
        change = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
        out[row]["spans"] = [{"start": int(a), "end": int(b)} for a, b in change.reshape(-1, 2)]
        out[row]["items"] = sorted(names.get(row, ()))
    return out


def _block(held: Phrases):
    @F.arrow_udf(KIND_SQL)
    def marked(column: pa.Array) -> pa.Array:
        return pa.array(mark(raw(column), held), KIND)

    return marked


def _merge(left: dict, right: dict) -> dict:
    spans: list[dict] = []
    for span in sorted(left["spans"] + right["spans"], key=lambda s: s["start"]):
        if spans and span["start"] <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], span["end"])
        else:
            spans.append(dict(span))
    return {"n_words": left["n_words"], "spans": spans, "items": sorted({*left["items"], *right["items"]})}


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[Phrases]:
    """The items in blocks of about ``block_bytes``, each read by itself."""
    held = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = -(-total // block_bytes)
    place = F.pmod(F.xxhash64("item", "text"), F.lit(number)) if number > 1 else F.lit(0)
    return [phrases([(r.item, r.text.encode()) for r in held.where(place == k).collect()]) for k in range(number)]


def matches(text: Column, blocks: list[Phrases]) -> Column:
    """Struct (n_words, spans, items) of a text; a block of items is one more pass over it in the same task."""
    @F.arrow_udf(KIND_SQL)
    def merged(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([_merge(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], KIND)

    found, *more = [_block(block)(text) for block in blocks or [phrases([])]]
    for other in more:
        found = merged(found, other)
    return found


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(found: Column, part: int = 20) -> Column:
    """At least one in ``part`` words lies in a benchmark window."""
    return (n_hit(found) > 0) & (F.lit(part) * n_hit(found) >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, hit words, items met, their digest and the verdict.

    NULL and empty texts have no words and no hits. Items without words have no window; repeated
    items count once; a NULL item_id is written as an empty string.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), matches(F.col(text_col), blocks_of(benchmark)).alias("found"))
    own = F.col("found")
    return found.select("doc_id", own["n_words"].alias("n_words"), n_hit(own).alias("n_hit"), F.size(own["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort(own["items"]), ","), 256).alias("items_sha256"), contaminated(own).alias("contaminated"))
