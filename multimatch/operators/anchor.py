"""Large dictionaries: anchor join (M3) and overlap resolution (M5).

When a dictionary is too large for one regex, matching becomes an equi-join on
hashes. A pattern's *anchor* is one of its stretches: the whole of a pattern
shorter than ``q`` characters, else ``q`` characters of it, from its start or, where
many patterns share that, from the offset whose characters are rarest in the corpus
and the dictionary (count-min sketches of both). Tasks hash the stretches of every
place of the corpus from running sums (``functions.texthash``); a place whose hash
is an anchor's is a candidate. The hash of the whole pattern is then compared with
the one at that place, which costs the same for any length, and what agrees is
compared as text. The output holds *every* occurrence, overlapping ones included;
``resolve_overlaps`` keeps the leftmost-shortest non-overlapping ones, which equals
the regex path.

Two routes, chosen by the dictionary's checked size:

* up to ``broadcast_rows`` patterns and ``broadcast_chars`` characters, tasks get the
  patterns themselves and the whole search is one pass without a shuffle;
* beyond, tasks get a blocked Bloom filter of all anchors (at most 64 MB, built by
  a distributed bit aggregation), so that one scan of the corpus finds the
  candidates whatever the number of patterns. They are joined with the anchors as
  numbers, and meet their texts again cut into segments no shorter than the
  longest pattern, so that a document of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texthash import Bloom, KeySet, Rolling, Window, codes, mix, visited, windows
from ..session import written
from .dictionary import active_dictionary, apply_alias, first_per_pattern
from .search import _keys

DEFAULT_Q = 16
SEGMENT = 1 << 18  # characters of a document verified together (the longest pattern, if longer)
SHARED_BY = 32  # patterns with one anchor before rarer ones are looked for
SLOTS = 1 << 16  # counters in each of the two rows of a sketch
BLOOM_BITS, MAX_WORDS = 16, 1 << 23  # bits per anchor, and 64-bit words of the filter at most
ROW = "_row"


def _plain(batch: pa.RecordBatch, column: int) -> list:
    """A text column as Python strings (bytes that are no UTF-8 as U+FFFD)."""
    return [None if b is None else b.decode("utf-8", "replace")
            for b in batch.column(column).cast(pa.binary()).to_pylist()]


PIECE = 1 << 22  # bytes of text decoded together


def pieces(batches, column: int):
    """The batches, cut where their texts are many, so that what a task holds does not grow with a batch."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PIECE, side="right")))
            yield b.slice(a, z - a)
            a = z


def _anchor_key(hashes: np.ndarray, length) -> np.ndarray:
    return mix(hashes ^ mix(np.atleast_1d(np.asarray(length, np.uint64))))


def _slots(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> np.uint64(48)).astype(np.int64), (keys >> np.uint64(32) & np.uint64(SLOTS - 1)).astype(np.int64)]


def gram_sketch(df: DataFrame, text: str, q: int) -> np.ndarray:
    """Count-min sketch of the ``q``-grams of all texts: two rows of ``SLOTS`` counters."""
    def run(batches):
        sums = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            for w in windows(_plain(b, 0), q - 1):
                keys = _anchor_key(Rolling(w.codes).grams(q)[:w.own], q)
                for r, s in enumerate(_slots(keys)):
                    sums[r] += np.bincount(s, minlength=SLOTS)
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["slot", "n"])

    got = df.select(F.col(text).alias("t")).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()  # 2 * SLOTS rows at most
    out = np.zeros(2 * SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(2, SLOTS)


def anchor_table(patterns: DataFrame, q: int = DEFAULT_Q, corpus: np.ndarray | None = None,
                 own: np.ndarray | None = None) -> DataFrame:
    """``patterns(line_no, pattern, replacement_id)`` with their anchors.

    Adds ``plen``, the anchor's length ``a`` and offset ``o``, its key ``h`` and the
    hash ``full`` of the whole pattern. With sketches of the corpus and of the
    dictionary, ``o`` is where the product of both counts is least.
    """
    def run(batches):
        for b in batches:
            rows = []
            for p in _plain(b, 1):
                h = Rolling(codes(p))
                n, o = len(h.sums) - 1, 0
                a = min(n, q)
                keys = _anchor_key(h.grams(a), a)
                if corpus is not None and n > a:
                    seen, mine = [np.minimum(*[row[s] for row, s in zip(sketch, _slots(keys))]) for sketch in (corpus, own)]
                    o = int(np.argmin((seen + 1.0) * mine))
                rows.append((n, a, o, keys[o], h.at(np.zeros(1, np.int64), np.array([n]))[0]))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(np.array(c, np.int32)) for c in cols[:3]],
                 *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[3:]]],
                ["line_no", "pattern", "replacement_id", "plen", "a", "o", "h", "full"])

    src = patterns.select(F.col("line_no").cast("int"), "pattern", F.col("replacement_id").cast("int"))
    return src.mapInArrow(run, "line_no int, pattern string, replacement_id int, plen int, a int, o int, h bigint, "
                               "full bigint")


def _anchors(df: DataFrame, text: str, dictionary: DataFrame, q: int, alias, drop_shadowed: bool) -> DataFrame:
    """The written anchor table of the patterns to be found."""
    if drop_shadowed:
        act = active_dictionary(dictionary, alias)
    else:
        # containment has no rule about NUL: only an empty pattern is left out
        act = first_per_pattern((apply_alias(dictionary, alias) if alias else dictionary).where(
            "length(pattern) > 0"))
    anchors = written(anchor_table(act, q), "anchors")
    most = anchors.where("plen > a").groupBy("h").count().agg(F.max("count").alias("n")).first()["n"]
    if most is not None and most > SHARED_BY:
        own = gram_sketch(anchors.where("plen >= a"), "pattern", q)
        anchors = written(anchor_table(anchors, q, gram_sketch(df, text, q), own), "anchors")
    return anchors


class Patterns:
    """The anchors of a dictionary that fits in memory, by anchor length."""

    def __init__(self, table: dict[str, np.ndarray]):
        self.full, self.plen = table["full"].view(np.uint64), table["plen"].astype(np.int64)
        self.classes = []
        for a in np.unique(table["a"]):
            mine = np.flatnonzero(table["a"] == a)
            keys = table["h"][mine].view(np.uint64)
            order = np.argsort(keys, kind="stable")
            found = KeySet(keys)
            first = np.searchsorted(keys[order], found.keys)
            self.classes.append((int(a), found, np.append(first, len(mine)), mine[order], table["o"][mine][order]))

    def occurrences(self, hashes: Rolling, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern of the places whose anchor and whole hash agree with a pattern's."""
        starts, which = [], []
        size = len(hashes.sums) - 1
        for a, found, first, pattern, offset in self.classes:
            at, key = found.find(_anchor_key(hashes.grams(a), a))
            many = (first[1:] - first[:-1])[key]
            entry = np.repeat(first[key] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            p = pattern[entry]
            s = np.repeat(at, many) - offset[entry]
            inside = np.flatnonzero((s >= 0) & (s < own) & (s + self.plen[p] <= size))
            s, p = s[inside], p[inside]
            same = hashes.at(s, self.plen[p]) == self.full[p]
            starts.append(s[same])
            which.append(p[same])
        return np.concatenate(starts), np.concatenate(which)


VERIFIED = 1 << 20  # characters compared together


def _agree(text: np.ndarray, at: np.ndarray, own: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length[i]`` characters of ``text`` from ``at[i]`` are those of ``own`` from ``begin[i]``."""
    out, done, a = np.ones(len(at), bool), np.cumsum(length), 0
    while a < len(at):
        before = done[a] - length[a]
        z = max(a + 1, int(np.searchsorted(done, before + VERIFIED, side="right")))
        n = length[a:z]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        out[a:z] = np.logical_and.reduceat(text[np.repeat(at[a:z], n) + step] == own[np.repeat(begin[a:z], n) + step], first)
        a = z
    return out


class Lines:
    """The patterns of a dictionary in a task: their anchors, characters and texts."""

    def __init__(self, table: dict[str, np.ndarray], texts: list[str]):
        self.model, self.table, self.texts = Patterns(table), table, pa.array(texts, pa.string())
        self.plen = table["plen"].astype(np.int64)
        self.chars = codes("".join(texts))
        self.begin = np.cumsum(self.plen) - self.plen

    def occurrences(self, w: Window) -> tuple[np.ndarray, np.ndarray]:
        """Place and pattern of every occurrence in a window, in no order."""
        at, p = self.model.occurrences(Rolling(w.codes), w.own)
        same = _agree(w.codes, at, self.chars, self.begin[p], self.plen[p])
        return at[same], p[same]

    def matches(self, w: Window, entry: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Place and pattern of the leftmost-shortest matches from ``entry``, and where the next window is entered.

        Documents are kept apart by separators, so one chain runs through all of a window.
        """
        at, p = self.occurrences(w)
        order = np.lexsort((self.plen[p], at))
        at, p = at[order], p[order]
        end = at + self.plen[p]
        path, _ = visited(np.searchsorted(at, end), int(np.searchsorted(at, entry)))
        at, p = at[path], p[path]
        last = int(end[path[-1]]) if len(path) else entry
        return at, p, max(last - w.own, 0) if w.goes_on else 0


def _empty(df: DataFrame, keys: list[str], row_id: bool) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], T.StructType([*df.select(*keys).schema.fields, *([T.StructField(ROW, T.LongType())] if row_id else []),
                          *_FOUND]))


_FOUND = [T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()),
          T.StructField("text", T.StringType()), T.StructField("replacement_id", T.IntegerType()),
          T.StructField("line_no", T.IntegerType())]


def find_candidates(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] = "doc_id",
                    text: str = "text", q: int = DEFAULT_Q, broadcast_rows: int = 500_000,
                    broadcast_chars: int = 1 << 25, alias=None, drop_shadowed: bool = True,
                    row_id: bool = False) -> DataFrame:
    """M3: every occurrence of every active pattern.

    ``<key>, start INT, length INT, text STRING, replacement_id INT, line_no INT``
    and, with ``row_id``, ``_row``: a number of the document's own, so that rows
    with a null or repeated key stay apart (the key itself is only carried).
    """
    anchors = _anchors(df, text, dictionary, q, alias, drop_shadowed)
    st = _measured(anchors)
    return _candidates(df, anchors, st, _fits(st, broadcast_rows, broadcast_chars), _keys(key), text, row_id)


def _candidates(df: DataFrame, anchors: DataFrame, st, fits: bool, given: list[str], text: str, row_id: bool) -> DataFrame:
    if not st["n"]:
        return _empty(df, given, row_id)
    # the key travels as one struct, so that its columns clash with none of these
    docs = df.select(F.struct(*given).alias("_keys"), F.col(text).alias("_text"),
                     F.monotonically_increasing_id().alias(ROW))
    if fits:
        found = _search(docs, shared_lines(anchors), int(st["longest"]))
    else:
        found = _join(written(docs, "documents"), anchors, int(st["n"]), int(st["longest"]), list(st["classes"]))
    return found.select(*[F.col("_keys").getField(k).alias(k) for k in given], *([ROW] if row_id else []),
                        *[f.name for f in _FOUND])


def _fits(st, broadcast_rows: int, broadcast_chars: int) -> bool:
    return st["n"] <= broadcast_rows and (st["chars"] or 0) <= broadcast_chars


def _measured(anchors: DataFrame):
    """Number, characters, greatest length and anchor lengths of the patterns."""
    return anchors.agg(F.count(F.lit(1)).alias("n"), F.max("plen").alias("longest"), F.sum("plen").alias("chars"),
                       F.sort_array(F.collect_set("a")).alias("classes")).first()


def shared_lines(anchors: DataFrame):
    """A function that gives the tasks the patterns (their size has been checked)."""
    got = anchors.toArrow()
    texts = got.column("pattern").to_pylist()
    table = {c: got.column(c).to_numpy() for c in ("plen", "a", "o", "h", "full", "replacement_id", "line_no")}
    shared = anchors.sparkSession.sparkContext.broadcast((table, texts))
    return lambda: Lines(*shared.value)


def in_tasks(df: DataFrame, text: str, dictionary: DataFrame, q: int = DEFAULT_Q, broadcast_rows: int = 500_000,
             broadcast_chars: int = 1 << 25, alias=None):
    """``(lines, longest)``: what gives the tasks the active patterns, and the length of the longest (0 if there is
    none); None if they are too many for that."""
    anchors = _anchors(df, text, dictionary, q, alias, True)
    st = _measured(anchors)
    return (shared_lines(anchors), int(st["longest"] or 0)) if _fits(st, broadcast_rows, broadcast_chars) else None


def _search(docs: DataFrame, lines, longest: int) -> DataFrame:
    """Every occurrence, by one pass over the corpus with the patterns in the tasks."""
    def run(batches):
        known = lines()
        for b in pieces(batches, 1):
            for w in windows(_plain(b, 1), longest - 1):
                at, p = known.occurrences(w)
                row, start = w.locate(at)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(2).take(row), pa.array(start.astype(np.int32)),
                     pa.array(known.table["plen"][p]), known.texts.take(pa.array(p)),
                     pa.array(known.table["replacement_id"][p]), pa.array(known.table["line_no"][p])],
                    ["_keys", ROW, *[f.name for f in _FOUND]])

    kind = T.StructType([docs.schema["_keys"], docs.schema[ROW], *_FOUND])
    return docs.mapInArrow(run, kind)


_MATCH = [T.StructField(n, T.IntegerType()) for n in ("ordinal", "start", "end", "length")] + [
    T.StructField("text", T.StringType()), T.StructField("replacement_id", T.IntegerType())]


def _resolved(docs: DataFrame, lines, longest: int) -> DataFrame:
    """The matches of ``docs(_keys, _text)``: a window's occurrences are resolved where they are found."""
    def run(batches):
        known = lines()
        for b in pieces(batches, 1):
            entry, count = 0, 0
            for w in windows(_plain(b, 1), longest - 1):
                at, p, entry = known.matches(w, entry)
                row, start = w.locate(at)
                # a document's matches are numbered on through its windows
                ordinal = np.arange(len(at)) - np.searchsorted(row, row) + np.where(row == w.rows[0], count, 0)
                count = count + len(at) if w.goes_on else 0
                n = known.plen[p]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in (ordinal, start, start + n, n)],
                     known.texts.take(pa.array(p)), pa.array(known.table["replacement_id"][p])],
                    ["_keys", *[f.name for f in _MATCH]])

    return docs.mapInArrow(run, T.StructType([docs.schema["_keys"], *_MATCH]))


def bloom_words(keys: DataFrame, n: int, bits: int = BLOOM_BITS) -> np.ndarray:
    """The words of a blocked Bloom filter of ``keys(h)``, ``n`` of them.

    Bits are put together per word by Spark; the driver receives one row per word
    that is not empty, ``MAX_WORDS`` at most.
    """
    size = min(MAX_WORDS, max(1 << 10, 1 << (n * bits // 64).bit_length()))
    shift = np.uint64(64 - (size.bit_length() - 1))

    def run(batches):
        for b in batches:
            k = np.unique(b.column(0).to_numpy().view(np.uint64))  # in the order of their words
            word = (k >> shift).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[:len(word)])
            mask = np.bitwise_or.reduceat(Bloom.masks(k), first) if len(k) else k
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(mask.view(np.int64))], ["word", "bits"])

    got = keys.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _join(docs: DataFrame, anchors: DataFrame, n: int, longest: int, classes: list[int]) -> DataFrame:
    """Candidates by one scan against the Bloom filter, joined with the anchors and verified by segment."""
    words = docs.sparkSession.sparkContext.broadcast(bloom_words(anchors.select("h"), n))

    def scan(batches):
        bloom = Bloom(words.value, np.zeros(0, np.uint64))
        for b in batches:
            for w in windows(_plain(b, 1), max(classes) - 1):
                hashes = Rolling(w.codes)
                for a in classes:
                    keys = _anchor_key(hashes.grams(a)[:w.own], a)
                    at = np.flatnonzero(bloom.has(keys))
                    row, place = w.locate(at)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), pa.array(place), pa.array(keys[at].view(np.int64))],
                        [ROW, "p", "h"])

    segment = max(SEGMENT, longest)
    cand = docs.select(ROW, "_text").mapInArrow(scan, f"{ROW} bigint, p bigint, h bigint")
    cand = cand.join(anchors.select("h", "o", "plen", "full"), "h").where(F.col("p") >= F.col("o"))
    start = (F.col("p") - F.col("o")).alias("s")
    cand = cand.select(ROW, start, "plen", "full").withColumn("seg", F.floor(F.col("s") / segment).cast("int"))
    cand = cand.groupBy(ROW, "seg").agg(F.collect_list(F.struct("s", "plen", "full")).alias("c"))
    # every segment carries the beginning of the next one
    parts = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{segment}}}"), 0)
    with_next = F.transform(F.array(parts), lambda a: F.transform(a, lambda t, i: F.concat(
        t, F.coalesce(F.substring(F.try_element_at(a, i + 2), 1, longest - 1), F.lit("")))))[0]
    texts = docs.select("_keys", ROW, F.posexplode(with_next).alias("seg", "t"))

    def verify(batches):
        for b in batches:
            for k, t in enumerate(_plain(b, 2)):
                before = b.column(3)[k].as_py() * segment
                start, plen, full = (x.to_numpy() for x in b.column(4)[k].values.flatten())
                s, hashes = start - before, Rolling(codes(t))
                inside = np.flatnonzero(s + plen < len(hashes.sums))
                s, plen, full = s[inside], plen[inside], full[inside]
                same = hashes.at(s, plen.astype(np.int64)) == full.view(np.uint64)
                s, plen = s[same], plen[same]
                row = pa.array(np.full(len(s), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), pa.array((s + before).astype(np.int32)),
                     pa.array(plen), pa.array([t[x:x + y] for x, y in zip(s.tolist(), plen.tolist())], pa.string())],
                    ["_keys", ROW, "start", "length", "text"])

    kind = T.StructType([docs.schema["_keys"], docs.schema[ROW], *_FOUND[:3]])
    found = texts.join(cand, [ROW, "seg"]).select("_keys", ROW, "t", "seg", "c").mapInArrow(verify, kind)
    # equal hashes are matches only if the text is a pattern's
    return found.join(anchors.select(F.col("pattern").alias("text"), "replacement_id", "line_no"), "text")


RESOLVE_BLOCK = 4096


def _numbers(t: pa.Table, n_keys: int) -> np.ndarray:
    """0-based number of the run of equal keys that each row belongs to."""
    new = np.zeros(t.num_rows, bool)
    for k in range(n_keys):
        code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _blocks(batches, n_keys: int):
    """Tables of whole blocks, from batches of rows sorted by block, and the number of each row's block."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        number = _numbers(held, n_keys)
        if len(number) and number[-1]:  # the last block may go on
            cut = int(np.searchsorted(number, number[-1]))
            yield held.slice(0, cut), number[:cut]
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held, _numbers(held, n_keys)


def _firsts(number: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its block."""
    return np.concatenate([[True], number[1:] != number[:-1]])


def _next_in_block(number: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first candidate of the same block that starts at or after each one's end, or the number
    of candidates (which is also its own successor)."""
    n, span = len(start), int(end.max()) + 1
    nxt = np.searchsorted(number * span + start, number * span + end)
    same = nxt < n
    same[same] = number[nxt[same]] == number[same]
    return np.append(np.where(same, nxt, n), n)


def _same(a: str, b: str, cols: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in cols]


def resolve_overlaps(cands: DataFrame, key: str | Sequence[str] = "doc_id",
                     block: int = RESOLVE_BLOCK) -> DataFrame:
    """M5: from all occurrences to ``<key>, ordinal, start, end, length, text, replacement_id``.

    The greedy choice depends on the end of the last *kept* match. A document is
    cut into blocks (of ``block`` characters, more if the longest match is longer),
    and what happens in a block is a function of the place where it is entered: the
    end of the last match kept before. Three steps, none of which gathers a document:

    1. per block, where the chain from each place of entry leaves off;
    2. most blocks leave off at one place wherever they are entered, which gives the
       next one's entry; runs of other blocks (matches that overlap throughout, as
       ``aa`` in ``aaaa...``) are followed by pointer doubling over (block, entry), in
       as many rounds as the logarithm of the longest run;
    3. each block keeps the chain from its entry.
    """
    keys = _keys(key)
    # the document's own number tells documents apart; without one the key has to
    doc = [ROW] if ROW in cands.columns else keys
    carried = keys if doc != keys else []
    seen = Observation("candidates")
    c = written(cands.select(*doc, *carried, "start", "length", "text", "replacement_id")
                .observe(seen, F.max("length").alias("n")), "candidates")
    longest = seen.get["n"] or 0
    size = max(block, longest)
    kb = [*doc, "_blk"]
    nk, at = len(kb), len(kb) + len(carried)
    c = c.withColumn("_blk", F.floor(F.col("start") / size).cast("bigint"))
    entries = _entries(c, doc, size, longest)

    def keep(batches):
        for t, number in _blocks(batches, nk):
            start = t.column(at).to_numpy().astype(np.int64)
            jump = _next_in_block(number, start, start + t.column(at + 1).to_numpy())
            first = _firsts(number)
            ok = start >= t.column(t.num_columns - 1).to_numpy()
            kept = np.zeros(len(start) + 1, bool)
            kept[-1] = True  # where every chain ends
            # the first candidate at or after the entry, then its chain by doubling
            kept[:-1] = ok & (first | ~np.concatenate([[False], ok[:-1]]))
            while True:
                to = jump[kept]
                if kept[to].all():
                    break
                kept[to] = True
                jump = jump[jump]
            mine = np.flatnonzero(kept[:-1])
            before = np.cumsum(kept[:-1]) - kept[:-1]
            rank = before - before[np.flatnonzero(first)][number - number[0]]
            out = t.take(pa.array(mine)).select(list(range(t.num_columns - 1)))
            yield from out.append_column("_rank", pa.array(rank[mine])).combine_chunks().to_batches()

    rows = c.alias("c").join(entries.alias("e"), _same("c", "e", kb), "left").select(
        *[F.col(f"c.{k}").alias(k) for k in [*kb, *carried]], "start", "length", "text", "replacement_id",
        F.coalesce("x", F.lit(0)).cast("bigint").alias("x"))
    kind = T.StructType([*rows.drop("x").schema.fields, T.StructField("_rank", T.LongType())])
    kept = written(rows.repartition(*kb).sortWithinPartitions(*kb, "start", "length").mapInArrow(keep, kind), "kept")
    earlier = SqlWindow.partitionBy(*doc).orderBy("_blk").rowsBetween(SqlWindow.unboundedPreceding, -1)
    offsets = kept.groupBy(*kb).agg(F.count(F.lit(1)).alias("_n")).select(
        *kb, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return kept.alias("k").join(offsets.alias("o"), _same("k", "o", kb)).select(
        *[F.col(f"k.{k}").alias(k) for k in keys], (F.col("_off") + F.col("_rank")).cast("int").alias("ordinal"),
        F.col("start").cast("int").alias("start"), (F.col("start") + F.col("length")).cast("int").alias("end"),
        F.col("length").cast("int").alias("length"), "text", F.col("replacement_id").cast("int").alias("replacement_id"))


def _entries(c: DataFrame, doc: list[str], size: int, longest: int) -> DataFrame:
    """``<doc>, _blk, x``: the place where blocks of ``c`` are entered, if it is not their beginning.

    No match is longer than a block, so a block is entered less than ``longest``
    beyond its beginning, and only where the block before it has candidates.
    """
    kb = [*doc, "_blk"]
    nk = len(kb)

    def summarise(batches):
        for t, number in _blocks(batches, nk):
            start = t.column(nk).to_numpy().astype(np.int64)
            end = start + t.column(nk + 1).to_numpy()
            last = np.arange(len(start))
            nxt = _next_in_block(number, start, end)
            last = np.where(nxt[:-1] < len(start), nxt[:-1], last)
            while not np.array_equal(last[last], last):
                last = last[last]
            leave, first = end[last], _firsts(number)
            # candidates that can be the first after an entry; runs of them that leave off at one place
            begin = t.column(nk - 1).to_numpy() * size
            can = first | (np.concatenate([[0], start[:-1]]) < begin + longest)
            can = np.flatnonzero(can)
            ends = np.append((leave[can][1:] != leave[can][:-1]) | (number[can][1:] != number[can][:-1]), True)
            run = can[ends]
            blocks = np.flatnonzero(first)
            offsets = np.append(np.searchsorted(number[run], number[blocks]), len(run))
            yield pa.RecordBatch.from_arrays(
                [*[x.combine_chunks() for x in t.select(list(range(nk))).take(pa.array(blocks)).columns],
                 pa.array(np.maximum.reduceat(end, blocks)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(start[run])),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(leave[run]))],
                [*kb, "reach", "upto", "leave"])

    kind = T.StructType([*[c.schema[k] for k in kb], T.StructField("reach", T.LongType()),
                         T.StructField("upto", T.ArrayType(T.LongType())),
                         T.StructField("leave", T.ArrayType(T.LongType()))])
    blocks = (c.select(*kb, "start", "length").repartition(*kb).sortWithinPartitions(*kb, "start", "length")
              .mapInArrow(summarise, kind))
    in_doc = SqlWindow.partitionBy(*doc).orderBy("_blk")
    near = F.lag("_blk").over(in_doc) == F.col("_blk") - 1
    # entered beyond the last candidate of its first run, a block may leave off elsewhere
    blocks = blocks.select("*", F.when(near, F.lag("leave").over(in_doc)).alias("from"),
                           (F.when(near, F.lag("reach").over(in_doc)) > F.col("upto")[0]).alias("open"))
    blocks = blocks.withColumn("open", F.coalesce("open", F.lit(False)))
    blocks = blocks.withColumn("after", F.when(F.col("from").isNotNull(), F.lag("open").over(in_doc)))
    seen = Observation("blocks")
    blocks = written(blocks.observe(seen, F.count_if("open").alias("n")), "blocks")
    begin = F.col("_blk") * size
    heads = blocks.where("not after").select(*kb, F.greatest(F.col("from")[0], begin).alias("x"))
    return _doubled(blocks.where("open"), heads, kb, size) if seen.get["n"] else heads


def _doubled(late: DataFrame, heads: DataFrame, kb: list[str], size: int) -> DataFrame:
    """Entries of all blocks, from ``heads``, those of blocks after one whose entry makes no difference.

    ``late`` are the blocks whose entry does. Jumps lead from an entry of such a
    block to the entry of the next; each round joins them with themselves.
    """
    doc, begin = kb[:-1], F.col("_blk") * size
    places = F.array_distinct(F.concat(F.array(begin), F.transform("from", lambda x: F.greatest(x, begin))))
    ins = late.select(*kb, "upto", "leave", F.explode(places).alias("x"))
    run = F.filter(F.arrays_zip("upto", "leave"), lambda p: p["upto"] >= F.col("x"))
    y = F.coalesce(F.try_element_at(run, F.lit(1))["leave"], F.col("x"))
    jumps = written(ins.select(*kb, "x", (F.col("_blk") + 1).alias("to"), F.greatest(y, begin + size).alias("y")), "jumps")
    found = written(heads, "entries")
    n = found.count()
    while True:
        step = found.alias("f").join(jumps.alias("j"), _same("f", "j", [*kb, "x"])).select(
            *[F.col(f"f.{k}").alias(k) for k in doc], F.col("j.to").alias("_blk"), F.col("j.y").alias("x"))
        found = written(found.unionByName(step).distinct(), "entries")
        now = found.count()
        if now == n:
            return found
        n = now
        jumps = written(jumps.alias("a").join(jumps.alias("b"), _same("a", "b", doc) + [
            F.col("a.to") == F.col("b._blk"), F.col("a.y") == F.col("b.x")]).select(
            *[F.col(f"a.{k}").alias(k) for k in [*kb, "x"]], F.col("b.to").alias("to"), F.col("b.y").alias("y")), "jumps")


def find_all_anchor(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] = "doc_id",
                    text: str = "text", q: int = DEFAULT_Q, alias=None, broadcast_rows: int = 500_000,
                    broadcast_chars: int = 1 << 25) -> DataFrame:
    """M3 + M5: the retry-mode match table through the anchor join.

    Documents may have null or repeated keys: each row is matched by itself, as by
    ``find_all``. While the patterns fit in the tasks, a task has all occurrences of
    a document's window at once and resolves them there, without a shuffle.
    """
    given = _keys(key)
    anchors = _anchors(df, text, dictionary, q, alias, True)
    st = _measured(anchors)
    if not st["n"] or not _fits(st, broadcast_rows, broadcast_chars):
        return resolve_overlaps(_candidates(df, anchors, st, False, given, text, True), key)
    docs = df.select(F.struct(*given).alias("_keys"), F.col(text).alias("_text"))
    found = _resolved(docs, shared_lines(anchors), int(st["longest"]))
    return found.select(*[F.col("_keys").getField(k).alias(k) for k in given], *[f.name for f in _MATCH])
