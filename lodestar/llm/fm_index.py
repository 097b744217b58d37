"""A compressed FM-index over integer symbols, in numpy.

The text's Burrows-Wheeler transform is kept in a wavelet matrix: one packed
bit vector per bit of the alphabet, with a count per 64 bits, so a rank costs
one table look-up and a population count per level. Suffixes are sorted by
their first ``depth`` symbols, which is all that backward search of patterns of up
to ``depth`` symbols needs. Searches take arrays of patterns and advance all of
them together.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class BitVector:
    """Bits with constant-time rank, one count per word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((len(bits) >> 6) + 1, "<u8")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """Occurrences of a symbol before a place, for arrays of both."""

    def __init__(self, symbols: np.ndarray, high: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        rest = symbols
        for shift in range(max(int(high).bit_length(), 1) - 1, -1, -1):
            bits = (rest >> shift) & 1 == 1
            zeros = int(len(bits) - np.count_nonzero(bits))
            self.levels.append((shift, BitVector(bits), zeros))
            rest = np.concatenate([rest[~bits], rest[bits]])
        alphabet = np.arange(high + 1)
        self.origin = self._walk(alphabet, np.zeros(high + 1, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbols, at) - self.origin[symbols]


class FMIndex:
    """Index of ``text``: symbols 1..high, 0 separates strings."""

    def __init__(self, text: np.ndarray, high: int, depth: int):
        self.depth, n = depth, len(text)
        rank, width = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < depth:
            follow = np.zeros(n, np.int64)
            follow[:max(n - width, 0)] = rank[width:]
            key = rank * (int(rank.max()) + 1) + follow
            order = np.argsort(key, kind="stable")
            steps = np.diff(key[order], prepend=-1) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(steps)
            width *= 2
        self.last = WaveletMatrix(text[order - 1].astype(np.int64), high)  # place 0 follows the final separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=high + 1))])

    def matched(self, patterns: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics from the right: how many trailing symbols of each
        row of ``patterns`` occur together at ``least`` or more places."""
        total, length = patterns.shape
        if length > self.depth:
            raise ValueError("patterns are longer than the sorted depth")
        out = np.zeros(total, np.int64)
        live = np.arange(total)
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for step in range(length):
            if step:
                symbols = patterns[live, length - 1 - step]
                low = self.first[symbols] + self.last.rank(symbols, low)
                high = self.first[symbols] + self.last.rank(symbols, high)
            enough = high - low >= least
            live, low, high = live[enough], low[enough], high[enough]
            out[live] = step + 1
            if not len(live):
                break
        return out
