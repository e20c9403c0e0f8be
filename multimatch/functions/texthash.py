"""Hashes of stretches of texts, for whole batches at once (numpy, inside tasks).

The documents of a batch are laid out as *windows*: arrays of code points in which
documents follow each other with a separator between them (a value that is no code
point, so that nothing matches across it); a long document is cut into windows that
look ahead as far as the longest pattern. From running sums of code points times
powers of a base, the hash of any stretch of a window follows from two sums.

``Rolling`` works modulo 2**64: fast, for finding candidates whose text is compared
afterwards. ``Prefixes`` uses two bases modulo 2**31 - 1: two different stretches of
``n`` characters agree in both with a probability of at most ``(n / 2**31) ** 2``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

WINDOW = 1 << 19  # characters
SEPARATOR = np.uint32(0xFFFFFFFF)

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_P = (1 << 31) - 1
_BASES = (1_103_515_245, 1_664_525_013)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (one to one)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Window:
    """``codes`` of some documents; matches may start at the first ``own`` places.

    Document ``k`` of the window is row ``rows[k]``; its first character here is
    character ``skip`` of its text (only a window's single document can have
    characters before it) and stands at ``base[k]``. ``goes_on``: the document
    continues in the next window.
    """

    codes: np.ndarray
    own: int
    rows: np.ndarray
    base: np.ndarray
    skip: int
    goes_on: bool

    def locate(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and character offset in its text of each place."""
        doc = np.searchsorted(self.base, at, side="right") - 1
        return self.rows[doc], at - self.base[doc] + self.skip


def windows(texts: Sequence[str | None], ahead: int, size: int = WINDOW) -> Iterator[Window]:
    """Lay out the texts of a batch; null and empty texts are left out."""
    rows, base, parts, used = [], [], [], 0

    def flush():
        return Window(np.concatenate(parts), used, np.array(rows), np.array(base), 0, False)

    for k, t in enumerate(texts):
        if not t:
            continue
        if len(t) > size:
            if parts:
                yield flush()
                rows, base, parts, used = [], [], [], 0
            for a in range(0, len(t), size):
                here = codes(t[a:a + size + ahead])
                last = a + size >= len(t)
                yield Window(np.append(here, SEPARATOR) if a + size + ahead >= len(t) else here,
                             min(size, len(t) - a), np.array([k]), np.array([0]), a, not last)
            continue
        if used + len(t) > size:
            yield flush()
            rows, base, parts, used = [], [], [], 0
        rows.append(k)
        base.append(used)
        parts += [codes(t), np.array([SEPARATOR])]
        used += len(t) + 1
    if parts:
        yield flush()


CHAIN = 512  # places followed together


def visited(after: np.ndarray, entry: int, block: int = CHAIN) -> tuple[np.ndarray, int]:
    """The chain from ``entry`` through ``after``, in order, and the first place of it beyond the end."""
    n = len(after)
    ends = np.minimum((np.arange(n) // block + 1) * block, n)
    leave = after.copy()
    inside = np.flatnonzero(leave < ends)
    while len(inside):
        leave[inside] = leave[leave[inside]]
        inside = inside[leave[inside] < ends[inside]]
    at, firsts = entry, []
    while at < n:
        firsts.append(at)
        at = int(leave[at])
    lanes, out = np.array(firsts, np.int64), []
    stop = ends[lanes]
    while len(lanes):
        out.append(lanes)
        lanes = after[lanes]
        going = lanes < stop
        lanes, stop = lanes[going], stop[going]
    return np.sort(np.concatenate(out)) if out else lanes, at


_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, up to the ``n``-th."""
    if base not in _made or len(_made[base]) <= n:
        steps = np.full(max(n, 1 << 12) + 1, base, np.uint64)
        steps[0] = 1
        _made[base] = np.multiply.accumulate(steps)
    return _made[base][:n + 1]


class Rolling:
    """Hashes modulo 2**64 of the stretches of a window."""

    def __init__(self, window: np.ndarray):
        n = len(window)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(window.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64,
                  out=self.sums[1:])
        self.back = _powers(_BACK, n)

    def grams(self, n: int) -> np.ndarray:
        """The hash of the ``n`` characters from every place that has them."""
        if n >= len(self.sums):
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[:len(self.sums) - n] + np.uint64(n))

    def at(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The hash of ``n[i]`` characters from ``start[i]``."""
        return mix((self.sums[start + n] - self.sums[start]) * self.back[start] + n.astype(np.uint64))


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_P)) + (x >> np.uint64(31))
    x = (x & np.uint64(_P)) + (x >> np.uint64(31))
    return np.where(x == _P, np.uint64(0), x)


def _residues(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**31 - 1, up to the ``n``-th."""
    out = _made.get(-base, np.ones(1, np.uint64))
    while len(out) <= n:
        out = np.concatenate([out, _fold(out * np.uint64(pow(base, len(out), _P)))])
    _made[-base] = out
    return out[:n + 1]


class Prefixes:
    """Keys of the stretches of a window: their hash in two bases, and their length."""

    def __init__(self, window: np.ndarray):
        n, self.codes = len(window), window
        value = _fold(window.astype(np.uint64) + np.uint64(1))
        self.sums, self.back = [], []
        for base in _BASES:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(_fold(value * _residues(base, n)[:n]), dtype=np.uint64, out=s[1:])
            self.sums.append(s)
            self.back.append(_residues(pow(base, -1, _P), n))

    def keys(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The key of ``n[i]`` characters from ``start[i]``."""
        one, two = [_fold(_fold(s[start + n] - s[start]) * b[start]) for s, b in zip(self.sums, self.back)]
        return mix((one << np.uint64(31) | two) ^ mix(n.astype(np.uint64)))


class KeySet:
    """A set of 64-bit keys that fits in memory: a table of slots, then the sorted keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = min(27, max(10, int(len(self.keys) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, bool)
        self.slots[self.keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that are in the set, and where they stand in ``self.keys``."""
        maybe = np.flatnonzero(self.slots[keys >> self.shift]) if len(self.keys) else np.zeros(0, np.int64)
        mine = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, mine), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == mine if len(self.keys) else np.zeros(0, bool)
        return maybe[hit], at[hit]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        out[self.find(keys)[0]] = True
        return out


class Bloom:
    """A blocked Bloom filter: three bits of one 64-bit word for each key.

    ``but_not``: keys known not to be in the set although their bits are.
    """

    def __init__(self, words: np.ndarray, but_not: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words).bit_length() - 1))
        self.but_not = KeySet(but_not)

    @staticmethod
    def masks(keys: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        return one << (keys & np.uint64(63)) | one << (keys >> np.uint64(6) & np.uint64(63)) | one << (
            keys >> np.uint64(12) & np.uint64(63))

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = self.masks(keys)
        out = self.words[keys >> self.shift] & mask == mask
        if len(self.but_not.keys):
            out &= ~self.but_not.has(keys)
        return out
