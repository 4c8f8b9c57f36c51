"""An FM-index over word numbers: suffix order, Burrows-Wheeler transform in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit planes of a sequence, packed 64 to a word with a count before each word; ranks of many symbols at once."""

    def __init__(self, sequence: np.ndarray, highest: int):
        self.planes = []
        for bit in range(max(1, int(highest).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            zeros = len(ones) - int(before[-1])
            self.planes.append((bit, words, before, zeros))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))
        self.first = self._walk(np.arange(highest + 1), np.zeros(highest + 1, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, words, before, zeros in self.planes:
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            under = (np.uint64(1) << inside) - np.uint64(1)
            ones = before[block] + np.bitwise_count(words[block] & under)
            at = np.where((symbols >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbols, at) - self.first[symbols]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes in the order of their first ``depth`` symbols (a power of two), by doubling."""
    rank, order, step = text.astype(np.int64), np.argsort(text), 1
    while step < depth:
        later = np.zeros(len(text), np.int64)
        later[:-step] = rank[step:] + 1 if step < len(text) else 0
        key = rank * (int(later.max()) + 1) + later
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        step *= 2
    return order


class FmIndex:
    """Counts and places of patterns of up to ``depth`` symbols in a text of numbers; 0 ends every part of the text.

    Suffixes are ordered by their first ``depth`` symbols. For patterns no longer than that, the rows of a
    pattern are contiguous and backward search gives the same intervals as with the full order.
    """

    def __init__(self, text: np.ndarray, depth: int = 32):
        self.text, self.depth = text, depth
        self.places = suffix_order(text, depth)
        highest = int(text.max())
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=highest + 1))))
        self.preceding = WaveletMatrix(text[self.places - 1], highest)

    def matches(self, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the text's own patterns that end (exclusive) at ``ends``.

        Backward search goes on while a pattern has more than one place, up to ``length`` symbols. Returns how
        many symbols matched in more than one place, and the rows [lo, hi) of the places of the last of them.
        """
        n = len(ends)
        matched, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.text))
        active = np.arange(n)
        for step in range(1, length + 1):
            symbols = self.text[ends[active] - step]
            both = self.preceding.rank(np.concatenate((symbols, symbols)), np.concatenate((lo[active], hi[active])))
            low, high = self.less[symbols] + both[: len(active)], self.less[symbols] + both[len(active) :]
            several = high - low > 1
            active = active[several]
            if not len(active):
                break
            lo[active], hi[active], matched[active] = low[several], high[several], step
        return matched, lo, hi

    def first_place(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest text position in each row interval; different intervals do not overlap."""
        if not len(lo):
            return np.empty(0, np.int64)
        starts, inverse = np.unique(lo, return_inverse=True)
        stops = np.empty(len(starts), np.int64)
        stops[inverse] = hi
        cuts = np.stack((starts, stops), axis=1).ravel()
        # a cut at the very end has no element after it; an extra one keeps it valid
        return np.minimum.reduceat(np.append(self.places, len(self.text)), cuts)[::2][inverse]
