"""SentencePiece encoding and decoding with a streaming Viterbi search.

The lattice has one state per character boundary; an arc is a vocabulary piece
(or one unknown character). In a unigram model the best state maximises the sum
of piece scores. In a BPE model the arcs are constrained instead: a piece may
follow another only if merging the two pieces' text gives exactly those two
pieces, which makes the surviving path of every boundary its BPE encoding.

The search keeps back pointers for a window bounded by the longest piece. When
the surviving paths of all boundaries in the window pass through one boundary,
everything before it is committed. Where no piece contains a non-space before a
space, that happens at every space, so words are encoded apart and remembered.
"""

from __future__ import annotations

import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the file format
UNIGRAM, BPE = 1, 2
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_REMEMBERED, MAX_WORD = 200_000, 48  # entries a task remembers, and the longest word among them


def fields(buf: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = buf[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = buf[at:at + n], at + n
        yield tag >> 3, value


class PieceModel:
    """Vocabulary of a SentencePiece model file, with ``encode`` and ``decode``."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.method, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                self.method = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(fields(value))
                if f.get(2):
                    raise ValueError("models with a character map are not supported: normalise the texts first")
                self.dummy_prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if self.method not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prepare()

    def prepare(self) -> None:
        usable = (NORMAL, USER_DEFINED, UNUSED)
        self.id_of = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in usable}
        self.score_of = {p: self.scores[i] for p, i in self.id_of.items()}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.window = max((len(p) for p in self.id_of), default=1)
        self.unknown_score = min(self.score_of.values(), default=0.0) - 10
        self.words_apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        self.text_of = ["" if t in (CONTROL, BYTE) else " ⁇ " if t == UNKNOWN else p.replace(SPACE, " ")
                        for p, t in zip(self.pieces, self.types)]
        self.inside = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        self.endings: dict | None = None
        self.known_words: dict[str, bytes] = {}
        self.known_units: dict[str, bytes] = {}
        self.known_pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by merging the best-scored adjacent pair, leftmost first."""
        parts, none = list(text), float("-inf")
        score = [self.score_of.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while score:
            best = max(score)
            if best == none:
                break
            at = score.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del score[at]
            for k in (at - 1, at):
                if 0 <= k < len(score):
                    score[k] = self.score_of.get(parts[k] + parts[k + 1], none)
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        """Whether two pieces side by side are the BPE encoding of their text."""
        key = (left, right)
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) >= MAX_REMEMBERED:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self.merged(left + right) == [left, right]
        return known

    def short_segment(self, text: str) -> list[str]:
        """``segment`` of a text no longer than the window, in a BPE model: one commit at its end."""
        if self.endings is None:  # pieces by their characters from the last to the first
            self.endings = {}
            for p in self.id_of:
                node = self.endings
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = p
        known = self.known_pairs
        ending = [""]  # the piece that ends at each boundary
        for end in range(1, len(text) + 1):
            node, start = self.endings, end
            while start:
                start -= 1
                node = node.get(text[start])
                if node is None:
                    piece = text[end - 1]  # an unknown character
                    break
                piece = node.get("") or (text[start] if start == end - 1 else None)
                if piece is not None:
                    if not start:
                        break
                    ok = known.get((ending[start], piece))
                    if ok or ok is None and self.may_follow(ending[start], piece):
                        break
            ending.append(piece)
        out, end = [], len(text)
        while end:
            out.append(ending[end])
            end -= len(ending[end])
        out.reverse()
        return out

    def segment(self, text: str):
        """The pieces of ``text``, in order, as soon as they are certain."""
        if self.method == BPE and len(text) <= self.window:
            yield from self.short_segment(text)
            return
        back = {0: (0, 0.0)}  # boundary -> start of the piece that ends there, score of the path
        base, n = 0, len(text)  # everything before base is committed
        last = ""  # the piece that ends at base
        for end in range(1, n + 1):
            best = None
            for start in range(max(base, end - self.window), end):
                state = back.get(start)
                if state is None:
                    continue
                piece = text[start:end]
                score = self.score_of.get(piece)
                if score is None:
                    if end - start > 1:
                        continue
                    score = self.unknown_score
                if self.method == BPE:
                    before = last if start == base else text[state[0]:start]
                    if not before or self.may_follow(before, piece):
                        best = (start, 0.0)
                        break
                elif best is None or state[1] + score > best[1]:
                    best = (start, state[1] + score)
            if best is not None:
                back[end] = best
            if end == n or end - base >= 4 * self.window:
                # where do the surviving paths of the window meet?
                meet = {n} if end == n else {b for b in range(end - self.window + 1, end + 1) if b in back}
                while len(meet) > 1:
                    top = max(meet)
                    meet.remove(top)
                    meet.add(back[top][0])
                joint = meet.pop()
                if joint > base:
                    cuts = [joint]
                    while cuts[-1] > base:
                        cuts.append(back[cuts[-1]][0])
                    cuts.reverse()
                    for a, b in zip(cuts, cuts[1:]):
                        last = text[a:b]
                        yield last
                    for b in [b for b in back if b < joint]:
                        del back[b]
                    base = joint

    def ids(self, text: str) -> array:
        """Ids of an already escaped text."""
        out = array("i")
        previous_unknown = False
        for piece in self.segment(text):
            i = self.id_of.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend([self.byte_ids[b] for b in piece.encode("utf-8", "replace")])
            elif not previous_unknown:
                out.append(self.unknown)
            previous_unknown = i is None
        return out

    def unit(self, text: str) -> bytes:
        """Ids of a stretch that no piece crosses the ends of, remembered if short."""
        known = self.known_units.get(text)
        if known is None:
            known = self.ids(text).tobytes()
            if len(text) <= MAX_WORD:
                if len(self.known_units) >= MAX_REMEMBERED:
                    self.known_units.clear()
                self.known_units[text] = known
        return known

    def word(self, word: str) -> bytes:
        """Ids of a word with its leading spaces, cut wherever no piece holds the two characters.

        A word whose last character is cut off is put together from the rest and
        that character, and only the rest is remembered.
        """
        if len(word) > 1 and word[-2:] not in self.inside:
            rest = word[:-1]
            return (self.known_words.get(rest) or self.word(rest)) + self.unit(word[-1])
        out, start = [], 0
        for k in range(1, len(word)):
            if word[k - 1:k + 1] not in self.inside:
                out.append(self.unit(word[start:k]))
                start = k
        out.append(self.unit(word[start:]))
        known = b"".join(out)
        if len(word) <= MAX_WORD:
            if len(self.known_words) >= MAX_REMEMBERED:
                self.known_words.clear()
            self.known_words[word] = known
        return known

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null and empty texts have none."""
        text = (text or "").replace(SPACE, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return np.empty(0, np.int32)
        if self.dummy_prefix:
            text = " " + text
        text = text.replace(" ", SPACE)
        if not self.words_apart or not self.byte_ids:  # runs of unknown characters may cross spaces
            return np.frombuffer(self.ids(text), np.int32)
        if text[0] != SPACE or SPACE + SPACE in text or text[-1] == SPACE:
            words = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
        else:
            words = text.replace(SPACE, " " + SPACE)[1:].split(" ")
        known = list(map(self.known_words.get, words))
        if None in known:
            known = [k if k is not None else self.word(w) for k, w in zip(known, words)]
        return np.frombuffer(b"".join(known), np.int32)

    def decode(self, ids) -> str:
        """Text of a sequence of ids; byte pieces are joined and decoded as UTF-8."""
        if not isinstance(ids, list):
            ids = ids.tolist()
        if self.byte_of and not self.byte_of.keys().isdisjoint(ids):
            out, raw = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    raw.append(b)
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.text_of[i])
            out.append(raw.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join([self.text_of[i] for i in ids])
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def read_model(path: str = DEFAULT_MODEL) -> PieceModel:
    """Load a model file on the driver (a vocabulary of bounded size)."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode_documents(docs: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``__ids, __decoded``: whole texts, there and back.

    Null and empty texts have no ids and decode to an empty text. ``__decoded``
    equals the text unless it holds U+2581 (which the format uses for a space)
    or the model normalises spaces. Repeated rows are each encoded; an empty table gives an
    empty result. Columns of these two names are replaced.
    """
    docs = docs.drop("__ids", "__decoded")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                rows = [model.encode(t) for t in part.column(at).to_pylist()]
                text = [model.decode(r) for r in rows]
                flat = np.concatenate(rows or [np.empty(0, np.int32)])
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(text, pa.string())],
                                                 [*part.schema.names, "__ids", "__decoded"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__ids", T.ArrayType(T.IntegerType())),
                           T.StructField("__decoded", T.StringType())])
    return docs.mapInArrow(tidy(run), schema)


def op9(spark, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Ids of every whole document, their number, and whether they decode to the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, read_model(model_path))
    return out.select("doc_id", F.size("__ids").cast("long").alias("n_ids"), F.col("__ids").alias("ids"),
                      (F.col("__decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
