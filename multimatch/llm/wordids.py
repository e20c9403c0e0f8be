"""Ids of whole texts by installed tokenizer libraries, without encoding a word twice.

A byte-level BPE file cuts a text before it merges anything, and always before a
space that follows a character other than white space: no alternative of its
pattern goes on across that space, and none looks back. So the text may be cut
there, equal words need encoding once, and the joined ids are those of the whole
text. A SentencePiece BPE model has no such pattern, but where no piece holds
another character before a space, no merge crosses the same place. Where a file
does not promise this (``apart`` is false), texts are given to the library whole.

Words with white space at their end, empty words and words ending in U+2581 are
joined with what follows before they are encoded.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from itertools import chain

import numpy as np
import regex
import sentencepiece
import tokenizers

from .pieces import BPE, BYTE, SPACE, PieceModel

REMEMBERED, LONGEST = 1_500_000, 64  # words a task remembers, and the bytes of the longest among them
PIECES = 200_000  # pieces of words remembered
NOTHING = np.zeros(0, np.int32)

# Fixed value: how byte-level BPE files of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(PATTERN)
# characters that every version of Unicode puts in the same one of the pattern's classes
_OTHER = regex.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f"
                       "\u2013-\u201e\u2026\u4e00-\u9fa5]")


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


class Library:
    """A vocabulary: ``bytes_of`` each id, and their ``length``."""

    def spells(self, ids: np.ndarray, sizes: np.ndarray, words: list[str]) -> np.ndarray:
        """Whether the ids of each word (``sizes`` of them) are its bytes."""
        raw = [w.encode() for w in words]
        each = list(map(self.bytes_of.__getitem__, ids.tolist()))
        if b"".join(each) == b"".join(raw):
            ends = np.cumsum(self.length[ids])[np.cumsum(sizes) - 1] if len(ids) else np.zeros(len(sizes))
            if np.array_equal(ends, np.cumsum([len(x) for x in raw])) and sizes.all():
                return np.ones(len(words), bool)
        ends = np.cumsum(sizes).tolist()
        return np.array([b"".join(each[a:z]) == r for a, z, r in zip([0, *ends], ends, raw)], bool)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, the others, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(others)}}


class ByteBpe(Library):
    """A byte-level BPE file of the tokenizers library; ``plain``: special tokens in texts are plain text."""

    def __init__(self, file: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(file)
        self.library = tokenizers.Tokenizer.from_str(file)
        self.library.encode_special_tokens = plain
        pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        self.apart = (model["type"] == "BPE" and spec["normalizer"] is None and not model.get("dropout")
                      and not spec["post_processor"] and pre.get("type") == "ByteLevel" and pre.get("use_regex")
                      and not pre["add_prefix_space"]
                      and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added))
        stands, special = byte_of_char(), {t["id"]: t["content"] for t in added}
        self.bytes_of = [b""] * (max([*model["vocab"].values(), *special]) + 1)
        for token, k in model["vocab"].items():
            self.bytes_of[k] = bytes([stands[c] for c in token])
        for k, content in special.items():
            self.bytes_of[k] = content.encode()
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.char_of = {b: c for c, b in stands.items()}
        self.known_pieces: dict[str, bytes] = {}
        self.model = self.library.model
        self.model._resize_cache(0)  # pieces are remembered here
        self.special = [] if plain else list(special.values())

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space before each, and the number of ids of each.

        What the pattern cuts out of words of common characters goes to the
        library's model piece by piece, each piece once; other words go to the
        library whole.
        """
        joined = "".join(words)
        if " " in joined or _OTHER.search(joined) or any(map(joined.__contains__, self.special)):
            odd = np.array([" " in w or _OTHER.search(w) is not None or any(map(w.__contains__, self.special))
                            for w in words], bool)
            parts = [self._cut([w for w, o in zip(words, odd) if not o]),
                     self.whole([" " + w for w, o in zip(words, odd) if o])]
            at = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            sizes = np.concatenate([p[1] for p in parts])
            starts = np.cumsum(sizes) - sizes
            order = np.argsort(at)
            size = sizes[order]
            flat = np.concatenate([p[0] for p in parts])
            return flat[np.repeat(starts[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size
        return self._cut(words)

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``spaced`` of words without a space in them."""
        if not words:
            return NOTHING, np.zeros(0, np.int64)
        # every word begins with the only piece that begins with a space
        pieces = _CUT.findall(" " + " ".join(words))
        first = np.flatnonzero(np.fromiter([p[0] == " " for p in pieces], bool, len(pieces)))
        known, tokenize, mapped = self.known_pieces, self.model.tokenize, self.char_of
        if len(known) > PIECES:
            known.clear()
        for p in {p for p in pieces if p not in known}:
            known[p] = array("i", [t.id for t in tokenize(p.encode().decode("latin-1").translate(mapped))]).tobytes()
        ids = list(map(known.__getitem__, pieces))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), np.int32), np.add.reduceat(sizes, first)


class Pieces(Library):
    """A SentencePiece BPE model of the sentencepiece library."""

    def __init__(self, data: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        mine = PieceModel(data)
        self.apart = mine.method == BPE and mine.words_apart and mine.dummy_prefix and not mine.squeeze
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(SPACE, " ").encode()
                         for p, t in zip(mine.pieces, mine.types)]
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.library.encode(texts, num_threads=1))

    spaced = whole  # the model puts the space before a text itself


def _end_table() -> np.ndarray:
    """Whether a text may be cut after each character of the basic plane, before a space.

    Letters, marks, numbers, punctuation and symbols are no white space in any
    version of Unicode; U+2581 is a space to SentencePiece.
    """
    good = np.array([unicodedata.category(chr(c))[0] in "LNMPS" for c in range(1 << 16)])
    good[ord(SPACE)] = False
    return good


_BYTES = np.random.default_rng(5).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Words:
    """Encodes lists of texts by one or more libraries; keeps the ids of words seen before.

    ``lead``: every text has a space before it (put there, or by the model itself).
    Texts are cut at spaces where a cut is safe, and a word is known by two 64-bit
    hashes of its bytes: words of a run are looked up together, unknown ones are
    encoded once, and texts are put together from the words' numbers. ``check``:
    find out which words the tokens of every library spell.
    """

    def __init__(self, libraries: list, lead: bool, check: bool = False):
        self.libraries, self.lead, self.check = libraries, lead, check
        self.apart = all(x.apart for x in libraries)
        self.ends = _end_table()
        self.back = self.forth = np.zeros(0, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of the known words, sorted
        self.seconds = np.zeros(0, np.uint64)
        self.numbers = np.zeros(0, np.int64)
        self.ids = [NOTHING for _ in self.libraries]
        self.starts = [np.zeros(1, np.int64) for _ in self.libraries]  # of each number's ids, and their end
        self.spelt = np.zeros(0, bool)

    def cuts(self, flat: np.ndarray) -> np.ndarray:
        """The spaces before which the text may be cut (its first character is none)."""
        at = np.flatnonzero(flat == 0x20)
        at = at[at > 0]
        last = flat[at - 1]
        good = (last > 0x20) & (last < 0x7F)
        wide = np.flatnonzero(last >= 0x80)
        p = at[wide]
        one, two, three = last[wide].astype(np.int64), flat[p - 2].astype(np.int64), flat[p - 3].astype(np.int64)
        char = np.where(two >= 0xC0, (two & 0x1F) << 6 | one & 0x3F,
                        np.where(three >> 4 == 0xE, (three & 0xF) << 12 | (two & 0x3F) << 6 | one & 0x3F, 0))
        good[wide] = self.ends[char]
        return at[good]

    def add(self, words: list[str], ids: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """Keep the ids and their numbers (by library) of words spelt so; the first one's number."""
        first, spelt = len(self.spelt), np.ones(len(words), bool)
        for k, (library, (flat, size)) in enumerate(zip(self.libraries, ids)):
            if self.check:
                spelt &= library.spells(flat, size, words)
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(size)])
            self.ids[k] = np.concatenate([self.ids[k], flat])
        self.spelt = np.concatenate([self.spelt, spelt])
        return first

    def hashed(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> list[np.ndarray]:
        """Two hashes of stretches of bytes; ``plain`` ones have no space before them."""
        if len(self.forth) <= len(flat):
            self.forth, self.back = _powers(_BASE, len(flat)), _powers(_BACK, len(flat))
        out = []
        for table in _BYTES:
            sums = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(table[flat] * self.forth[:len(flat)], dtype=np.uint64, out=sums[1:])
            h = (sums[end] - sums[start]) * self.back[start] + np.where(plain, np.uint64(1 << 40), np.uint64(0))
            h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
            out.append(h ^ h >> np.uint64(32))
        return out

    def encode(self, texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """By library, the ids of the texts (UTF-8) one after the other and the number of ids of each;
        and (if checked) whether the tokens of every library spell the text, with the space before it."""
        if len(self.spelt) > REMEMBERED or not self.apart:
            self.forget()
        if not self.apart:
            plain = [t.decode() for t in texts]
            lead = [" " + t for t in plain] if self.lead else plain
            first = self.add(lead, [lib.whole(plain if isinstance(lib, Pieces) else lead) for lib in self.libraries])
            return self.joined(np.arange(first, first + len(texts)), np.ones(len(texts), np.int64))
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        raw = b"".join(texts)
        flat = np.frombuffer(raw, np.uint8)
        begins = (ends - sizes)[sizes > 0]
        # a text's first character is no cut, and what follows its last one belongs to it
        cuts = np.setdiff1d(np.setdiff1d(self.cuts(flat), begins, assume_unique=True), ends - 1)
        # a word is what follows a cut's space, or a text's beginning, up to the next one
        at = np.concatenate([begins, cuts])
        start = np.concatenate([begins, cuts + 1])
        plain = np.zeros(len(start), bool)
        plain[:len(begins)] = not self.lead
        order = np.argsort(at)
        at, start, plain = at[order], start[order], plain[order]
        end = np.append(at[1:], len(flat))
        counts = np.searchsorted(at, ends) - np.searchsorted(at, ends - sizes)
        one, two = self.hashed(flat, start, end, plain)
        distinct, which, back = np.unique(one, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            known = (self.hashes[near] == distinct) & (self.seconds[near] == two[which])
        number = np.zeros(len(distinct), np.int64)
        number[known] = self.numbers[near[known]]
        new = np.flatnonzero(~known)
        for bare in (False, True):
            mine = new[plain[which[new]] == bare]
            if len(mine):
                words = [raw[a:z].decode() for a, z in zip(start[which[mine]].tolist(), end[which[mine]].tolist())]
                ids = [lib.whole(words) if bare else lib.spaced(words) for lib in self.libraries]
                first = self.add(words if bare else [" " + w for w in words], ids)
                number[mine] = np.arange(first, first + len(mine))
        keep = new[(end - start)[which[new]] <= LONGEST]
        place = np.searchsorted(self.hashes, distinct[keep])
        self.hashes = np.insert(self.hashes, place, distinct[keep])
        self.seconds = np.insert(self.seconds, place, two[which[keep]])
        self.numbers = np.insert(self.numbers, place, number[keep])
        return self.joined(number[back], counts)

    def joined(self, at: np.ndarray, counts: np.ndarray):
        """Ids of texts from the numbers of their words (``counts`` words each)."""
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for ids, starts in zip(self.ids, self.starts):
            size = starts[at + 1] - starts[at]
            total = np.concatenate([[0], np.cumsum(size)])
            out.append((ids[np.repeat(starts[at] - total[:-1], size) + np.arange(total[-1])], np.diff(total[bounds])))
        wrong = np.concatenate([[0], np.cumsum(~self.spelt[at])])
        return out, np.diff(wrong[bounds]) == 0


def utf8(text: bytes | None) -> bytes:
    """The bytes of a text, those that are no UTF-8 replaced (U+FFFD); null is empty."""
    if not text:
        return b""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def remembered(state: dict, name: str, build):
    """``state[name]``, built on first use.

    ``state`` is a broadcast dictionary: a worker keeps it from task to task, so
    that what is built in one task serves the next.
    """
    if name not in state:
        state[name] = build()
    return state[name]
