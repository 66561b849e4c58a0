"""An FM-index over a sequence of small integers, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

#: Suffix numbers must fit into this many bits, so that two ranks and a number make one sort key.
PLACE_BITS = 20
MOST = 1 << PLACE_BITS
_PLACE = MOST - 1


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys the index of each run's first element, and whether a run has more than one."""
    fresh = np.append(True, keys[1:] != keys[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    return first, ~(fresh & np.append(fresh[1:], True))


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of the suffixes of ``text``, whose last symbol is its only 0.

    Prefix doubling, first over as many symbols as fit into a key, then over the still tied
    suffixes alone.
    """
    n = len(text)
    span = max(1, (63 - PLACE_BITS) // bits)
    padded = np.append(text.astype(np.int64), np.zeros(span, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(span):
        key = key << bits | padded[k:n + k]
    order = np.sort(key << PLACE_BITS | np.arange(n))
    suffixes = order & _PLACE
    first, tied = _runs(order >> PLACE_BITS)
    rank = np.empty(n, np.int64)
    rank[suffixes] = first
    slots = np.flatnonzero(tied)
    while len(slots):
        own = suffixes[slots]
        order = np.sort((rank[own] << PLACE_BITS | rank[own + span]) << PLACE_BITS | np.arange(len(own)))
        own = own[order & _PLACE]
        first, tied = _runs(order >> PLACE_BITS)
        suffixes[slots] = own
        rank[own] = slots[first]
        slots = slots[tied]
        span *= 2
    return suffixes


class WaveletTree:
    """Ranks and symbols of a sequence, one bit of the symbols per level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones_from = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            zeros = np.append(0, np.cumsum(1 - bit)).astype(np.int32)
            self.zeros.append(zeros)
            self.ones_from.append(int(zeros[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.first = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for depth in range(self.bits):
            zeros = self.zeros[depth][places]
            bit = (symbols >> (self.bits - 1 - depth)) & 1
            places = np.where(bit == 1, self.ones_from[depth] + places - zeros, zeros)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbols, places) - self.first[symbols]

    def symbol_and_rank(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbols = np.zeros(len(places), np.int64)
        for depth in range(self.bits):
            zeros = self.zeros[depth][places]
            bit = 1 - (self.zeros[depth][places + 1] - zeros)
            symbols = symbols << 1 | bit
            places = np.where(bit == 1, self.ones_from[depth] + places - zeros, zeros)
        return symbols, places - self.first[symbols]


class FmIndex:
    """Index of ``text`` (symbols from 1 below 2**bits, fewer than ``MOST``)."""

    def __init__(self, text: np.ndarray, bits: int, sampling: int = 16):
        text = np.append(text, 0).astype(np.int64)
        self.size = len(text)
        suffixes = suffix_array(text, bits)
        self.tree = WaveletTree(text[suffixes - 1], bits)
        self.smaller = np.append(0, np.cumsum(np.bincount(text, minlength=1 << bits)))[:1 << bits]
        chosen = suffixes % sampling == 0
        self.sampled = chosen
        self.sample_number = np.cumsum(chosen) - 1
        self.samples = suffixes[chosen]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern; shorter ones are padded with -1 on the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        active = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            active = active[(patterns[active, column] >= 0) & (low[active] < high[active])]
            if not len(active):
                break
            symbol = patterns[active, column]
            both = self.tree.rank(np.tile(symbol, 2), np.concatenate([low[active], high[active]]))
            low[active] = self.smaller[symbol] + both[:len(active)]
            high[active] = self.smaller[symbol] + both[len(active):]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of index rows, walking back to the next sampled suffix."""
        places = np.zeros(len(rows), np.int64)
        active, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(active):
            here = rows[active]
            done = self.sampled[here]
            places[active[done]] = self.samples[self.sample_number[here[done]]] + steps
            active = active[~done]
            symbols, before = self.tree.symbol_and_rank(rows[active])
            rows[active] = self.smaller[symbols] + before
            steps += 1
        return places
