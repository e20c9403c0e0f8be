"""A compressed full-text index over word numbers: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit-packed wavelet matrix of a sequence of symbols below ``2 ** levels``."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels = levels
        self.words, self.before, self.zeros = [], [], []
        seq = seq.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.start = self.descend(np.arange(1 << levels), np.zeros(1 << levels, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefixes of length ``at`` end in the last level's order, per symbol."""
        for k in range(self.levels):
            word, off = at >> 6, (at & 63).astype(np.uint64)
            low = self.words[k][word] & ((np.uint64(1) << off) - np.uint64(1))
            ones = self.before[k][word] + np.bitwise_count(low)
            bit = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.descend(symbol, at) - self.start[symbol]


class FMIndex:
    """Index over texts of symbols 1.., each ended by a 0, for patterns up to ``depth`` symbols.

    Suffixes are ordered by their first ``depth`` symbols (at least), which is all
    that backward search over patterns of that length needs.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < depth:
            ahead = np.zeros(n, np.int64)
            ahead[:n - width] = rank[width:] + 1
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + ahead, return_inverse=True)
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        levels = max(1, int(text.max(initial=0)).bit_length())
        self.bwt = WaveletMatrix(text[self.order - 1], levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << levels))])

    def matches(self, text: np.ndarray, ends: np.ndarray, length: int,
                least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each end: interval ``lo, hi`` and matched length.

        Every pattern is extended to the left, one symbol a step, while its
        interval holds at least ``least`` suffixes, up to ``length`` symbols: the
        matching statistics of ``text`` capped at ``length``. The interval is that
        of the last extension that held.
        """
        symbol = text[ends]
        lo, hi = self.first[symbol].copy(), self.first[symbol + 1].copy()
        size = (hi - lo >= least).astype(np.int64)
        live = np.flatnonzero(size)
        for step in range(1, length):
            if not live.size:
                break
            symbol = text[ends[live] - step]
            a = self.first[symbol] + self.bwt.rank(symbol, lo[live])
            b = self.first[symbol] + self.bwt.rank(symbol, hi[live])
            good = b - a >= least
            live = live[good]
            lo[live], hi[live] = a[good], b[good]
            size[live] = step + 1
        return lo, hi, size
