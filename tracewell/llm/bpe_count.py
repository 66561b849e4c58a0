"""Token counts by byte-pair merging with a heap over a linked list (operator 10).

The count of a pre-token is its number of bytes minus the number of merges; no identifiers are
looked up. Counts of short pre-tokens are remembered in a bounded table per task.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

MEMO_ENTRIES = 400_000
MEMO_CHARS = 64
WHOLE_CHARS = 1 << 20

# Fixed value: the public pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte: printable Latin-1 itself, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PairCounter(dict):
    """Maps a pre-token to its number of tokens; missing ones are merged and remembered."""

    def __init__(self, merges: list, specials: list[str], limit: int = MEMO_ENTRIES):
        super().__init__()
        letters = {letter: byte for byte, letter in byte_letters().items()}
        self.ranks = {}
        for rank, pair in enumerate(merges):
            left, right = (bytes(letters[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[left, right] = rank
        self.limit = limit
        self.split = regex.compile(PRE_TOKEN)
        longest_first = sorted(specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if specials else None

    def __missing__(self, piece: str) -> int:
        count = self.merged(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = count
        return count

    def merged(self, data: bytes) -> int:
        """Symbols left when no adjacent pair has a rank."""
        n = len(data)
        symbol: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks.get
        heap = [(rank, i, symbol[i], symbol[i + 1]) for i in range(n - 1)
                if (rank := ranks((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbol[i] is not None else n
            if j >= n or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], symbol[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            merges += 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := ranks((symbol[a], symbol[b]))) is not None:
                    heapq.heappush(heap, (rank, a, symbol[a], symbol[b]))
        return n - merges

    def count(self, text: str) -> int:
        total, at = 0, 0
        for found in self.special.finditer(text) if self.special else ():
            total += self._plain(text[at:found.start()]) + 1
            at = found.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        if len(text) <= WHOLE_CHARS:
            return sum(map(self.__getitem__, self.split.findall(text)))
        return sum(self[found.group()] for found in self.split.finditer(text))


@lru_cache(maxsize=2)
def load(path: str) -> PairCounter:
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    step = held["pre_tokenizer"]
    added = held.get("added_tokens", [])
    plain = held["model"]["type"] == "BPE" and step["type"] == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
    if not plain or held.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    return PairCounter(held["model"]["merges"], [t["content"] for t in added])


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a text; NULL and empty texts have none.

    ``path`` is the tokenizer's JSON file, present on every worker. Special strings inside a text
    count as one token each, as the public library counts them.
    """
    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        counter = load(path)
        return pa.array([counter.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its bytes, tokens and whether it has more than ``limit`` tokens.

    NULL counts as the empty text; repeated rows stay repeated; other columns are not read.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = held.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
