"""Removal of word passages that an earlier document already has, through FM-indexes.

A window is ``WINDOW`` consecutive words of one document. Each word covered by a
window that also starts in a document with a smaller id is removed.

1. *Routing.* Streaming every document against every index is quadratic. The
   window's anchor, the word ``GRAM``-gram of smallest hash inside it, depends on
   the window's words alone, so equal windows have equal anchors. Consecutive
   windows with one anchor form a segment. Anchors found in one document only
   are dropped after a combined count per anchor.
2. *Segments.* The texts with shared anchors give their segments. Equal segments
   collapse to one with the smallest and largest id. An anchor in more than
   ``HOT`` documents is cut to single windows routed by the window's own hash, so
   no anchor gathers a group that grows with the data.
3. *Index.* The segments of a shard (about ``SHARD_WORDS`` words) form one
   compressed FM-index; backward search over its wavelet matrix gives the
   matching statistics of every window, and the smallest id in the interval of
   each full-length match.
4. *Removal.* Windows whose smallest id is below the document's own are covered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slots, materialise, slot_set, tidy
from .fmindex import FMIndex

WINDOW = 13
GRAM = 6
HOT = 20_000
SHARD_WORDS = 1_000_000
CHUNK = 2 << 20  # bytes of text handled at a time

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        for b in (_BASE, _BACK):
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        del _powers[:-2]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a byte string (a rolling hash, then mixed)."""
    inside = ~_SPACE[flat]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    forward, back = _power(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * forward[:len(flat)], dtype=np.uint64, out=total[1:])
    return _mix((total[end] - total[start]) * back[start]), start


def segments(texts: list, window: int = WINDOW, gram: int = GRAM):
    """Segments of the texts (bytes): anchor, text number, first window, number of windows.

    Windows never span two texts; texts of fewer than ``window`` words have none.
    """
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    flat = np.frombuffer(b" ".join([t or b"" for t in texts]), np.uint8)
    h, start = word_hashes(flat)
    doc = np.searchsorted(np.cumsum(sizes + 1), start, side="right")
    n = len(h) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none, none, none
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        g = (g + h[k:k + len(g)]) * np.uint64(_BASE)
    g = _mix(g)
    # leftmost position of the smallest gram hash within the window, by doubling
    best, covered, span = np.arange(len(g)), 1, window - gram + 1
    while covered < span:
        step = min(covered, span - covered)
        left, right = best[:len(best) - step], best[step:]
        best, covered = np.where(g[right] < g[left], right, left), covered + step
    at = np.flatnonzero(doc[:n] == doc[window - 1:])
    if not at.size:
        return none.view(np.uint64), none, none, none
    new = np.concatenate([[True], (best[at][1:] != best[at][:-1]) | (np.diff(at) != 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    owner = doc[at[first]]
    origin = np.searchsorted(doc, owner)  # the text's first word
    return g[best[at[first]]], owner, at[first] - origin, count


def runs(texts: list):
    """Split a batch into (first, texts) runs of about ``CHUNK`` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def anchors_of(src: DataFrame, slots=None) -> DataFrame:
    """(anchor, id) of every segment of (id, text); with ``slots`` only of those that may be in the set."""
    shared = None if slots is None else src.sparkSession.sparkContext.broadcast(slots)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, part in runs(b.column(1).to_pylist()):
                anchor, owner, _, _ = segments(part)
                if shared is not None:
                    keep = in_slots(shared.value, anchor.view(np.int64))
                    anchor, owner = anchor[keep], owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(ids[first + owner].astype(np.int64))], ["anchor", "id"])

    return src.mapInArrow(tidy(run), "anchor bigint, id bigint")


def some_of(src: DataFrame, slots) -> DataFrame:
    """The rows of (id, text, ...) whose id may be in a slot set, so that fewer texts are shuffled."""
    shared = src.sparkSession.sparkContext.broadcast(slots)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(in_slots(shared.value, b.column(0).to_numpy(zero_copy_only=False))))

    return src.mapInArrow(tidy(run), src.schema)


def _pieces(batches):
    """(id, text_hash, first, route, words) of every segment, or window, with a shared anchor."""
    for b in batches:
        out = ([], [], [], [], [])
        for i, h, text, cold, hot in zip(*[c.to_pylist() for c in b.columns]):
            words = text.split()
            anchor, _, first, count = segments([text])
            anchor = anchor.view(np.int64)
            cold_at = np.isin(anchor, np.array(cold, np.int64))
            hot_at = np.isin(anchor, np.array(hot, np.int64))
            for k in np.flatnonzero(cold_at | hot_at):
                a, n = int(first[k]), int(count[k])
                cuts = [(a, n)] if cold_at[k] else [(a + x, 1) for x in range(n)]
                for start, m in cuts:
                    piece = b" ".join(words[start:start + m + WINDOW - 1])
                    out[0].append(i)
                    out[1].append(h)
                    out[2].append(start)
                    # a window of a hot anchor is routed by its own words
                    out[3].append(int(anchor[k]) if cold_at[k] else xxhash.xxh64_intdigest(piece, 1) - (1 << 63))
                    out[4].append(piece)
            if len(out[0]) > 50_000:
                yield _piece_batch(out)
                out = ([], [], [], [], [])
        yield _piece_batch(out)


def _piece_batch(out) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                      ["id", "text_hash", "first", "route", "words"])


def search_shard(words: list, lowest: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, list]:
    """The segments with something to remove and the smallest id of each of their windows.

    ``words`` are distinct segments (bytes, joined by one space), ``lowest`` and
    ``highest`` the ids of the documents each occurs in.
    """
    tokens = [w.split(b" ") for w in words]
    size = np.array([len(t) for t in tokens], np.int64)
    number, _ = pd.factorize(np.array([x for t in tokens for x in t], object))
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(begin[-1], np.int64)
    owner = np.repeat(np.arange(len(words)), size + 1)
    real = np.ones(len(text), bool)
    real[begin[1:] - 1] = False
    text[real] = number + 1
    windows = size - WINDOW + 1
    seg = np.repeat(np.arange(len(words)), windows)
    off = np.concatenate([[0], np.cumsum(windows)])
    ends = begin[seg] + np.arange(off[-1]) - off[seg] + WINDOW - 1
    smallest = lowest[seg]
    index = FMIndex(text, WINDOW)
    # a window that occurs once in the shard matches nothing else: two suffixes at least
    lo, hi, length = index.matches(text, ends, WINDOW, least=2)
    full = np.flatnonzero(length == WINDOW)
    if full.size:
        low_of = lowest[owner[index.order]]
        classes, which = np.unique(lo[full], return_inverse=True)
        last = np.zeros(len(classes), np.int64)
        last[which] = hi[full]
        cut = np.stack([classes, np.minimum(last, len(low_of) - 1)], axis=1).ravel()
        least = np.minimum.reduceat(low_of, cut)[::2]
        tail = last == len(low_of)  # the interval that reaches the end
        if tail.any():
            least[tail] = np.minimum(least[tail], low_of[-1])
        smallest[full] = least[which]
    some = np.flatnonzero(np.logical_or.reduceat(smallest < highest[seg], off[:-1])) if len(words) else []
    return np.asarray(some, np.int64), [smallest[off[k]:off[k + 1]] for k in some]


def _index_shard(table: pa.Table) -> pa.Table:
    words = table.column("words").to_pylist()
    some, lists = search_shard(words, table.column("lowest").to_numpy().copy(),
                               table.column("highest").to_numpy().copy())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
    return pa.table({"route": table.column("route").take(pa.array(some)).combine_chunks(),
                     "seg": table.column("seg").take(pa.array(some)).combine_chunks(),
                     "smallest": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))})


def covered_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, starts``: the windows of each text that a smaller id has too."""
    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    shared = materialise(anchors_of(src).groupBy("anchor").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a < b").select("anchor", (F.col("n") > HOT).alias("hot")), "anchors")
    rows = anchors_of(src, slot_set(shared, "anchor"))
    of_doc = materialise(rows.join(shared, "anchor").groupBy("id").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"),
        F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot")), "anchors-of")
    found = some_of(src, slot_set(of_doc, "id")).join(of_doc, "id").select(
        "id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "text", "cold", "hot")
    pieces = found.mapInArrow(tidy(_pieces), "id bigint, text_hash bigint, first int, route bigint, words binary")
    # a segment is named by its route and the hash of its words, 128 bits together
    pieces = materialise(pieces.withColumn("seg", F.xxhash64("words")), "pieces")

    total = pieces.select(F.sum(F.length("words"))).first()[0] or 0
    shards = max(64, math.ceil(total / (6 * SHARD_WORDS)))
    distinct = pieces.groupBy("route", "seg", "words").agg(F.min("id").alias("lowest"), F.max("id").alias("highest"))
    smallest = (distinct.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
                .groupBy("shard").applyInArrow(_index_shard, "route bigint, seg bigint, smallest array<bigint>"))
    smallest = materialise(smallest, "smallest")
    hits = pieces.select("id", "text_hash", "first", "route", "seg").join(smallest, ["route", "seg"])
    starts = F.filter(F.transform("smallest", lambda m, k: F.when(m < F.col("id"), F.col("first") + k)),
                      lambda x: x.isNotNull())
    return (hits.select("id", "text_hash", starts.alias("starts")).where("size(starts) > 0")
            .groupBy("id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))


def kept_words(text: bytes | None, starts) -> tuple[list, int]:
    """The words left of a text and how many were removed."""
    words = text.split() if text else []
    if starts is None or not len(starts):
        return words, 0
    gone = np.zeros(len(words) + 1, np.int64)
    at = np.asarray(starts, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + WINDOW, -1)
    stay = np.cumsum(gone)[:-1] == 0
    return [w for w, s in zip(words, stay.tolist()) if s], int(len(words) - stay.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``__n_words, __n_removed, __kept``.

    ``__kept`` is the words left, joined by one space. Windows are judged on the
    input, not on what is left. A null text has no words; a row with a null id
    loses nothing and makes no other lose anything; rows of equal id do not make
    each other lose anything; an empty table gives an empty result. Ids are
    integers. Columns of the three names are replaced.
    """
    docs = docs.drop("__n_words", "__n_removed", "__kept")
    gone = materialise(covered_windows(docs, id_col, text_col).withColumnsRenamed(
        {"id": "__id", "text_hash": "__text_hash", "starts": "__starts"}), "covered")
    touched = docs.sparkSession.sparkContext.broadcast(slot_set(gone, "__id"))
    n, key, at = len(docs.columns), docs.columns.index(id_col), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()),
                           T.StructField("__n_removed", T.LongType()), T.StructField("__kept", T.StringType())])

    def cut(b, starts):
        total, removed, kept = [], [], []
        for i, text in enumerate(b.column(at).cast(pa.binary()).to_pylist()):
            words, k = kept_words(text, starts[i].values.to_numpy() if starts is not None and starts[i].is_valid
                                  else None)
            total.append(len(words) + k)
            removed.append(k)
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays(
            [*b.columns[:n], pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], [f.name for f in schema])

    def untouched(batches):  # texts that lose nothing are done where they are read
        for b in batches:
            ids = b.column(key)
            mine = in_slots(touched.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(
                zero_copy_only=False)
            yield cut(b.filter(pa.array(~mine)), None)

    def others(batches):
        for b in batches:
            ids = b.column(key)
            mine = in_slots(touched.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(
                zero_copy_only=False)
            yield b.filter(pa.array(mine))

    def marked(batches):
        for b in batches:
            yield cut(b, b.column(n))

    rest = docs.mapInArrow(tidy(others), docs.schema)
    both = rest.join(gone, (rest[id_col].cast("long") == gone["__id"])
                     & (F.xxhash64(rest[text_col]) == gone["__text_hash"]), "left").drop("__id", "__text_hash")
    return docs.mapInArrow(tidy(untouched), schema).unionByName(both.mapInArrow(tidy(marked), schema))


def op7(spark, sf_dir: str) -> DataFrame:
    """Words and removed words of every document, and a digest of the words kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"),
        F.sha2("__kept", 256).alias("kept_sha256"))
