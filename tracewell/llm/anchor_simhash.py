"""SimHash near-duplicates through anchor points of a covering code (operator 8).

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of either the
lower or the upper half. Each half of 32 bits is covered by a code of covering radius one (a perfect
Hamming code on 31 bits times all values of the last bit). A half is sent to every codeword within
the covering radius plus one, at most 17 of the 2**27. The codeword that covers one of two linked
fingerprints is then within that distance of the other, so they meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from tracewell.llm.common import LOWER, batch_of, raw
from tracewell.llm.graph import components
from tracewell.session import cut_lineage

SHINGLE = 3
SEED = 42
DISTANCE = 3
PART = 1 << 17
BROADCAST_IDS = 2_000_000
SETTLED = 64


def fingerprint_of(text: bytes | None) -> int:
    """Bits set in over half of the shingles' hashes; 0 without a word."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(SHINGLE, len(words))
    first, last = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    count = np.zeros(64, np.int64)
    for k in range(0, len(first), PART):
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[k:k + PART], last[k:k + PART])), np.uint64)
        count += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(first)).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint of a text as a signed long; 0 for NULL and texts without a word."""
    @F.arrow_udf("long")
    def printed(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t) for t in raw(column)], np.uint64).view(np.int64))

    return printed(text)


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the bit patterns that lead to the codewords within distance two, and their number."""
    table, number = np.zeros((32, 17), np.uint32), np.full(32, 17)
    top = 1 << 31
    for s in range(32):
        near = 1 << (s - 1) if s else 0
        own = [near, near | top] + [1 << (a - 1) | 1 << (b - 1) for a in range(1, 32) if s and a < (b := a ^ s) and s not in (a, b)]
        number[s] = len(own)
        table[s, :len(own)] = own
    return table, number


FLIPS, FLIP_COUNT = _flips()


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.uint8)
    for bit in range(31):
        out ^= ((half >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8) * np.uint8(bit + 1)
    return out


def anchors_of(fingerprints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For either half the anchors (with the half in bit 32) and the number of the fingerprint of each."""
    for side in range(2):
        half = ((fingerprints >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        syndrome = _syndrome(half)
        number = FLIP_COUNT[syndrome]
        owner = np.repeat(np.arange(len(half)), number)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        yield (half[owner] ^ FLIPS[syndrome[owner], place]).astype(np.int64) | (side << 32), owner


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column(0).to_numpy()
        for anchor, owner in anchors_of(own.view(np.uint64)):
            yield batch_of({"anchor": (pa.int64(), anchor), "fp": (pa.int64(), own[owner])})


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    found = parent[nodes]
    while True:
        above = parent[found]
        if np.array_equal(above, found):
            parent[nodes] = found
            return found
        found = above


def _unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    while True:
        a, b = _roots(parent, left), _roots(parent, right)
        open_ = a != b
        if not open_.any():
            return
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def links_in(anchor: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by anchor: links that join all fingerprints near each other at an anchor, at most one per row."""
    n = len(own)
    parent = np.arange(n)
    begin, end = np.searchsorted(anchor, anchor, "left"), np.searchsorted(anchor, anchor, "right")
    bits = own.view(np.uint64)
    active, step = np.arange(n), 1
    while True:
        active = active[active + step < end[active]]
        if not len(active):
            break
        near = np.bitwise_count(bits[active] ^ bits[active + step]) <= DISTANCE
        if near.any():
            _unite(parent, active[near], active[near] + step)
        if step >= SETTLED and step & (step - 1) == 0:
            # Where an anchor's rows are all joined by now, further pairs can add nothing.
            heads = np.unique(begin[active])
            root = _roots(parent, np.arange(n))
            whole = np.zeros(n, bool)
            for head in heads:
                whole[head] = (root[head:end[head]] == root[head]).all()
            active = active[~whole[begin[active]]]
        step += 1
    root = _roots(parent, np.arange(n))
    linked = np.flatnonzero(root != np.arange(n))
    return own[linked], own[root[linked]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (anchor, fp): whole anchors at a time."""
    held_anchor, held_own = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def ready(anchor: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        a, b = links_in(anchor, own)
        return batch_of({"a": (pa.int64(), a), "b": (pa.int64(), b)})

    for batch in batches:
        anchor, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts.append((anchor, own))
        if anchor[0] == anchor[-1] and (len(parts) == 1 or parts[0][0][0] == anchor[-1]):
            continue
        held_anchor, held_own = (np.concatenate(x) for x in zip(*parts))
        cut = np.searchsorted(held_anchor, held_anchor[-1], "left")
        parts = [(held_anchor[cut:], held_own[cut:])]
        if cut:
            yield ready(held_anchor[:cut], held_own[:cut])
    if parts:
        yield ready(*(np.concatenate(x) for x in zip(*parts)))


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that give the same components as all pairs within three bits.

    Every pair that meets at an anchor is compared in the task of that anchor; what leaves the task
    is a forest, at most one link per row.
    """
    spread = fingerprints.select("fp").distinct().mapInArrow(_spread, "anchor long, fp long")
    met = spread.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(_compared, "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, name: Column, *more: Column) -> DataFrame:
    """Rows (doc_id, fp, name, more): ``name``, over doc_id and more, is the least of the row's component."""
    prints = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"), *more))
    nodes = prints.groupBy("fp").agg(F.min(name).alias("first"))
    roots = components(links(nodes)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    held = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = held.groupBy("root").agg(F.min("first").alias("name"))
    return prints.join(held.join(names, "root").select("fp", "name"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (long) and component_id, the smallest doc_id reachable by links.

    Texts without a word share fingerprint zero and so a component. A NULL doc_id gets its
    component but is never one's name unless all its members are NULL. Repeated rows stay repeated.
    """
    return _grouped(docs, id_col, text_col, F.col("doc_id")).select("doc_id", "fp", F.col("name").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the fingerprint as 16 hexadecimal digits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that with the smallest doc_id, NULL last, and of rows that share it
    with different texts that with the smallest hash. Of rows that repeat both one stays.
    """
    number = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("kept number")
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("kept number").alias("number"))
    found = cut_lineage(_grouped(docs, id_col, text_col, name, number).withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("name.id")) & (F.col("kept number") == F.col("name.number"))).groupBy("doc_id", "kept number", "stays").count())

    def rows(own: DataFrame) -> DataFrame:
        return own.select(F.col("doc_id").alias("kept id"), F.col("kept number").alias("found number"))

    numbered = docs.withColumn("kept number", number)
    same = numbered[id_col].eqNullSafe(F.col("kept id")) & (F.col("kept number") == F.col("found number"))
    # Up to this many rows go to the documents, which then are not shuffled; beyond it both sides are.
    lost = rows(found.where("NOT stays"))
    kept = numbered.join(F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost, same, "left_anti")
    repeated = rows(found.where("stays AND count > 1"))
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").dropDuplicates([id_col, "kept number"])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.drop("kept number")
