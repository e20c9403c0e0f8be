"""Simple-8b: varying counts of whole numbers packed into 64-bit words.

The four high bits of a word select how many numbers its 60 low bits hold, the
first one lowest; greedily the selector with the most numbers that all fit is
taken. A number of more than 60 bits is an escape: selector 0, and the low bits
are its place in the block's list of escaped numbers. Blocks of ``BLOCK`` numbers
begin at a word of their own, and a table has each block's first word and first
escape, so that blocks are decoded alone, in any order, or all at once.

A packed array, little-endian: ``MAGIC``, numbers, blocks, words and escapes as
64-bit counts, two tables of (blocks + 1) 32-bit places, words, escaped numbers.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8BLK\x00\x00\x01"
BLOCK = 512

# Numbers in a word, and bits of each, by selector. Selector 0 is the escape.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

_COUNT = np.array(COUNTS, np.int64)
_PAYLOAD = np.uint64((1 << 60) - 1)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned number needs (0 for 0)."""
    if not len(values) or values.max() < 1 << 32:
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def choices(need: np.ndarray) -> np.ndarray:
    """The selector of a word that begins at each place of each row of ``need`` (bits, zeros beyond a row's end)."""
    out = np.where(need <= 60, 15, 0).astype(np.uint8)
    wide, span = need, 1
    for selector in range(14, 0, -1):  # the counts rise
        n = COUNTS[selector]
        grown = wide.copy()
        grown[:, :-(n - span)] = np.maximum(wide[:, :-(n - span)], wide[:, n - span:])
        wide, span = grown, n
        out[wide <= WIDTHS[selector]] = selector
    return out


def pack(values: np.ndarray, block: int = BLOCK) -> bytes:
    """Pack unsigned numbers below 2**64."""
    values = np.asarray(values).astype(np.uint64)
    n = len(values)
    blocks = -(-n // block)
    padded = np.zeros((blocks, block + COUNTS[1]), np.uint64)
    flat = np.zeros(blocks * block, np.uint64)
    flat[:n] = values
    padded[:, :block] = flat.reshape(blocks, block)
    size = np.full(blocks, block)
    if blocks:
        size[-1] = n - block * (blocks - 1)
    selectors = choices(bit_lengths(padded.ravel()).reshape(padded.shape))
    # all blocks step from word to word together
    at, alive, where, taken = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while len(alive):
        s = selectors[alive, at[alive]]
        where.append(alive * padded.shape[1] + at[alive])
        taken.append(s)
        at[alive] += _COUNT[s]
        alive = alive[at[alive] < size[alive]]
    place = np.concatenate([*where, np.zeros(0, np.int64)])
    taken = np.concatenate([*taken, np.zeros(0, np.uint8)])
    order = np.argsort(place, kind="stable")
    place, taken = place[order], taken[order]
    owner, source = place // padded.shape[1], padded.ravel()
    words = taken.astype(np.uint64) << np.uint64(60)
    for selector in range(2, 16):
        mine = np.flatnonzero(taken == selector)
        for k in range(COUNTS[selector]):
            words[mine] |= source[place[mine] + k] << np.uint64(k * WIDTHS[selector])
    mine = np.flatnonzero(taken == 0)
    first_escape = np.searchsorted(owner[mine], np.arange(blocks + 1))
    words[mine] |= (np.arange(len(mine)) - first_escape[owner[mine]]).astype(np.uint64)
    head = np.array([n, blocks, len(words), len(mine)], "<u8")
    tables = np.concatenate([np.searchsorted(owner, np.arange(blocks + 1)), first_escape]).astype("<u4")
    return b"".join([MAGIC, head.tobytes(), tables.tobytes(), words.astype("<u8").tobytes(),
                     source[place[mine]].astype("<u8").tobytes()])


class Packed:
    """A packed array, decoded whole or from ``first`` up to ``last``, touching only the blocks in between."""

    def __init__(self, data: bytes, block: int = BLOCK):
        if data[:len(MAGIC)] != MAGIC:
            raise ValueError("not a packed array")
        self.block, at = block, len(MAGIC)
        self.n, self.blocks, words, escapes = (int(x) for x in np.frombuffer(data, "<u8", 4, at))
        at += 32
        self.first_word = np.frombuffer(data, "<u4", self.blocks + 1, at).astype(np.int64)
        at += 4 * (self.blocks + 1)
        self.first_escape = np.frombuffer(data, "<u4", self.blocks + 1, at).astype(np.int64)
        at += 4 * (self.blocks + 1)
        self.words = np.frombuffer(data, "<u8", words, at)
        self.escaped = np.frombuffer(data, "<u8", escapes, at + 8 * words)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.uint64)
        b0, b1 = first // self.block, -(-last // self.block)
        a, z = self.first_word[b0], self.first_word[b1]
        words = self.words[a:z]
        selector = (words >> np.uint64(60)).astype(np.int64)
        words = words & _PAYLOAD
        owner = np.repeat(np.arange(b0, b1), np.diff(self.first_word[b0:b1 + 1]))
        count = _COUNT[selector]
        ends = np.cumsum(count)
        begins = ends - count
        # a block's last word may hold more than the block does
        place = begins - begins[self.first_word[owner] - a] + (owner - b0) * self.block
        limit = np.minimum((owner - b0 + 1) * self.block, self.n - b0 * self.block)
        out = np.zeros(min(b1 * self.block, self.n) - b0 * self.block, np.uint64)
        for s in range(2, 16):
            mine = np.flatnonzero(selector == s)
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for k in range(COUNTS[s]):
                to = place[mine] + k
                inside = to < limit[mine]
                if not inside.all():
                    mine, to = mine[inside], to[inside]
                out[to] = words[mine] >> np.uint64(k * WIDTHS[s]) & mask
        mine = np.flatnonzero(selector == 0)
        out[place[mine]] = self.escaped[self.first_escape[owner[mine]] + words[mine].astype(np.int64)]
        return out[first - b0 * self.block:last - b0 * self.block]
