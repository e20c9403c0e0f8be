"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts every letter trigram of every training text per language (on the
executors; one row per language and distinct trigram is shuffled and written). A
language has every trigram of its texts, but for those that only a foreign passage
can explain: a trigram whose rate is below ``REL_RATE`` of what some other language
surely has. Sure is the lower bound ``(n - SURE * sqrt(n)) / total`` of the other
language's rate, so that a trigram seen less than ``SURE ** 2`` times in a language
never takes it from another one, however short that language's text is.

The filters of all languages share their hash positions: slot ``i`` holds a
bitmask of the languages with bit ``i`` set, so the AND of a trigram's ``N_HASH``
slots returns all languages that (perhaps) contain it. The slots are put together
by a distributed OR; the driver receives the slots, ``MAX_SLOTS`` for each 64
languages at most, and never a trigram. A document's trigrams are counted per
language bit; the count is corrected by the filter's false-positive rate and the
largest corrected count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, tidy

N_HASH = 3
SLOTS_PER_GRAM = 24
MAX_SLOTS = 1 << 22  # more trigrams than these hold raise the false-positive rate, which is corrected for
REL_RATE, SURE = 0.1, 3.0
UNDETERMINED = "und"
CHUNK = 1 << 20  # code points handled at a time

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for everything else."""
    global _letters
    if _letters is None:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters = t
    return _letters


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of the texts and the text each belongs to.

    A trigram is a letter with its two neighbours, a non-letter neighbour
    counting as 0; nulls have none. Texts are joined by a non-letter, so no
    trigram spans two.
    """
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    flat = "\0".join([t or "" for t in texts]) + "\0"
    code = letter_table()[np.frombuffer(flat.encode("utf-32-le", "replace"), "<u4")].astype(np.uint64)
    mid = np.flatnonzero(code)
    if not mid.size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    before = code[mid - 1] * (mid > 0).astype(np.uint64)
    gram = (before << np.uint64(42)) | (code[mid] << np.uint64(21)) | code[mid + 1]
    return gram, np.searchsorted(np.cumsum(sizes + 1), mid, side="right")


def slots(gram: np.ndarray, mask: int) -> list[np.ndarray]:
    """The ``N_HASH`` filter positions of each trigram (double hashing of a 64-bit mix)."""
    x = gram * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(40)) | np.uint64(1)
    return [((x + np.uint64(i) * step) & np.uint64(mask)).astype(np.int64) for i in range(N_HASH)]


@dataclass
class LanguageFilters:
    """Bit-sliced filters: ``words[w][slot]`` holds languages 64 w .. 64 w + 63."""

    languages: list[str]
    words: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> "LanguageFilters":
        languages = sorted(grams)
        most = max((len(g) for g in grams.values()), default=1)
        size = 1 << max(10, (SLOTS_PER_GRAM * most - 1).bit_length())
        words = np.zeros(((len(languages) + 63) // 64, size), np.uint64)
        for k, name in enumerate(languages):
            for at in slots(np.asarray(grams[name], np.uint64), size - 1):
                words[k // 64][at] |= np.uint64(1 << (k % 64))
        return cls.of_words(languages, words)

    @classmethod
    def of_words(cls, languages: list[str], words: np.ndarray) -> "LanguageFilters":
        fill = [float(((words[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean())
                for k in range(len(languages))]
        return cls(languages, words, np.array(fill) ** N_HASH)

    def counts(self, gram: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """How many trigrams of each of ``n`` documents each language (perhaps) contains."""
        out = np.zeros((n, len(self.languages)), np.int64)
        if not gram.size:
            return out
        at = slots(gram, self.words.shape[1] - 1)
        for w in range(len(self.words)):
            found = self.words[w][at[0]]
            for a in at[1:]:
                found = found & self.words[w][a]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                bit = ((found >> np.uint64(k % 64)) & np.uint64(1)).astype(np.float64)
                out[:, k] = np.bincount(doc, weights=bit, minlength=n)
        return out

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.

        The score is the share of the text's trigrams that the language contains,
        corrected for false positives. No letter, or no language learned: ``und``
        and 0. Equal counts: the language first in name order.
        """
        gram, doc = trigrams(texts)
        total = np.bincount(doc, minlength=len(texts)).astype(np.float64)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        seen = self.counts(gram, doc, len(texts))
        fixed = np.clip((seen - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)
        best = fixed.argmax(axis=1)
        top = fixed[np.arange(len(texts)), best]
        score = np.clip(np.divide(top, total, out=np.zeros_like(top), where=total > 0), 0, 1)
        return [self.languages[b] if t else UNDETERMINED for b, t in zip(best, total)], score


def pieces(texts: list):
    """Split a batch of texts into runs of about ``CHUNK`` characters: (first, texts)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def count_trigrams(rows: DataFrame) -> DataFrame:
    """``lang, gram, n``: occurrences of each trigram over all rows of (lang, text)."""

    def run(batches):
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, part in pieces(texts):
                own = names[first:first + len(part)]
                known = sorted(set(own))
                number = np.array([known.index(x) for x in own])
                gram, doc = trigrams(part)
                for k, name in enumerate(known):
                    g, n = np.unique(gram[number[doc] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())],
                        ["lang", "gram", "n"])

    return rows.mapInArrow(tidy(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def language_trigrams(rows: DataFrame) -> DataFrame:
    """``lang, gram``: the trigrams of each language, from all rows of (lang, text).

    Rows with a null in either teach nothing.
    """
    counts = materialise(count_trigrams(rows.where("lang IS NOT NULL AND text IS NOT NULL")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(totals, "lang").select(
        "lang", "gram", (F.col("n") / F.col("total")).alias("rate"),
        ((F.col("n") - SURE * F.sqrt("n")) / F.col("total")).alias("sure"))
    top = rate.groupBy("gram").agg(F.max("sure").alias("top"))
    return rate.join(top, "gram").where(F.col("rate") >= REL_RATE * F.col("top")).select("lang", "gram")


def train(rows: DataFrame) -> LanguageFilters:
    """Filters from all rows of (lang, text)."""
    kept = materialise(language_trigrams(rows), "language-trigrams")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # one row per language
    languages = sorted(r["lang"] for r in sizes)
    most = max((r["n"] for r in sizes), default=1)
    size = min(MAX_SLOTS, 1 << max(10, (SLOTS_PER_GRAM * most - 1).bit_length()))
    number = {name: k for k, name in enumerate(languages)}

    def run(batches):
        for b in batches:
            k = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            at = np.concatenate(slots(b.column(1).to_numpy().view(np.uint64), size - 1))
            key = at + size * np.tile(k // 64, N_HASH)
            bit = np.uint64(1) << np.tile(k % 64, N_HASH).astype(np.uint64)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            bits = np.bitwise_or.reduceat(bit[order], first) if len(first) else bit
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(bits.view(np.int64))], ["slot", "bits"])

    got = kept.mapInArrow(tidy(run), "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((len(languages) + 63) // 64 * size, np.uint64)
    words[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return LanguageFilters.of_words(languages, words.reshape(-1, size))


def held_out(id_col: str, buckets: int = 3, bucket: int = 1):
    """Whether a row's crc32 bucket is the one kept out of learning (null ids: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % buckets == bucket, F.lit(False))


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``__lang, __lang_score`` (see ``LanguageFilters.predict``).

    Columns of these names are replaced. Whole texts are read; nulls and texts without a letter give ``und`` and 0;
    repeated rows are each predicted; an empty table gives an empty result.
    """
    docs = docs.drop("__lang", "__lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            names, scores = [], []
            for _, part in pieces(b.column(at).to_pylist()):
                lang, score = shared.value.predict(part)
                names += lang
                scores.append(score)
            flat = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(flat)],
                                             [*b.schema.names, "__lang", "__lang_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()),
                           T.StructField("__lang_score", T.DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def learn_from(docs: DataFrame) -> LanguageFilters:
    """Learn from text and lang of the rows that are not held out."""
    return train(docs.where(~held_out("doc_id")).select("lang", "text"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn_from(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__lang").alias("lang_pred"),
                        F.col("__lang_score").alias("score"))
