"""M2 for dictionaries of any size: the single walk that consumes a mismatching character.

From a place where a walk begins, it follows the trie as far as the text goes along:
``d`` characters. If a pattern ends there, it is a match and the next walk begins
behind it; else the mismatching character is consumed too, and it begins at ``d + 1``
characters from here. So the next place is a function of the place, and the walk is
the chain of these places from the beginning of the text.

* ``d`` is the longest stretch from a place that is a prefix of a pattern, found by
  doubling and then binary search over a table of the keys of all prefixes
  (``functions.texthash.Prefixes``), for all places of a window at once. A pattern
  of 10,000 characters costs 14 steps, and only where the text follows it.
* The chain is followed by pointer doubling inside blocks, then from block to block.

The keys of all prefixes go to the tasks if there are at most ``node_limit``; else a
blocked Bloom filter of them does (at most 64 MB). A filter says yes too often,
never no: depths can only come out too large, and what the walk relied on is joined
with the table of prefixes afterwards. Keys that are no prefix are set apart and
the walk is repeated without them, until all it relied on is right.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texthash import Bloom, KeySet, Prefixes, codes, visited, windows
from ..session import written
from .anchor import _plain, bloom_words, pieces
from .dictionary import active_dictionary
from .search import _keys

NODE_LIMIT = 8_000_000
NONE = np.zeros(0, np.uint64)


def prefix_keys(patterns: DataFrame) -> DataFrame:
    """``key, ends``: the key of every prefix of ``patterns(pattern)``, and whether it is a whole pattern."""
    def run(batches):
        for b in batches:
            for p in _plain(b, 0):
                n = np.arange(1, len(p) + 1)
                keys = Prefixes(codes(p)).keys(np.zeros(len(p), np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n == len(p))], ["key", "ends"])

    return patterns.select("pattern").mapInArrow(run, "key bigint, ends boolean").groupBy("key").agg(
        F.max("ends").alias("ends"))


def depths(prefixes: Prefixes, own: int, longest: int, nodes) -> np.ndarray:
    """How far the trie can be followed from each of the first ``own`` places."""
    limit = np.minimum(longest, len(prefixes.sums[0]) - 1 - np.arange(own))
    low, high = np.zeros(own, np.int64), limit + 1
    # one character: whatever is at a place, so each distinct character is looked up once
    chars = np.flatnonzero(np.bincount(np.minimum(prefixes.codes[:own], 0x110000)))
    first = np.zeros(0x110001, bool)
    first[chars] = nodes.has(Prefixes(chars.astype(np.uint32)).keys(np.arange(len(chars)), np.ones(len(chars), np.int64)))
    first[0x110000] = False  # the separator
    alive, n = np.flatnonzero(first[np.minimum(prefixes.codes[:own], 0x110000)]), 2
    alive = alive[limit[alive] >= 1]
    low[:], high[:] = 0, 1
    low[alive], high[alive] = 1, limit[alive] + 1
    while len(alive) and n <= longest:
        alive = alive[limit[alive] >= n]
        ok = nodes.has(prefixes.keys(alive, np.full(len(alive), n)))
        high[alive[~ok]] = n
        alive = alive[ok]
        low[alive] = n
        n *= 2
    alive = np.flatnonzero(high - low > 1)
    while len(alive):
        mid = (low[alive] + high[alive]) // 2
        ok = nodes.has(prefixes.keys(alive, mid))
        low[alive[ok]] = mid[ok]
        high[alive[~ok]] = mid[~ok]
        alive = alive[high[alive] - low[alive] > 1]
    return low


_KIND = [T.StructField("ordinal", T.IntegerType()), T.StructField("start", T.IntegerType()),
         T.StructField("length", T.IntegerType()), T.StructField("text", T.StringType()),
         T.StructField("key", T.LongType()), T.StructField("ends", T.BooleanType())]


def _walk(docs: DataFrame, model, longest: int, claims: bool) -> DataFrame:
    """Matches of ``docs(_keys, _text)`` and, with ``claims``, rows of the keys the walk relied on.

    ``model()`` gives, in a task, the sets of prefixes and of whole patterns.
    """
    def run(batches):
        nodes, whole = model()
        for b in pieces(batches, 1):
            bodies = _plain(b, 1)
            entry, count = 0, 0
            for w in windows(bodies, longest):
                prefixes = Prefixes(w.codes)
                depth = depths(prefixes, w.own, longest, nodes)
                # from a place where no pattern begins the walk goes to the next one, so only others are followed
                some = np.flatnonzero(depth)
                ends = np.zeros(w.own, bool)
                ends[some] = whole.has(prefixes.keys(some, depth[some]))
                after = some + depth[some] + ~ends[some]
                path, _ = visited(np.searchsorted(some, after), int(np.searchsorted(some, entry)))
                at = max(int(after[path[-1]]) if len(path) else entry, w.own)
                path = some[path]
                hit = path[ends[path]]
                row, start = w.locate(hit)
                # a document's matches are numbered on through its windows
                first = np.searchsorted(row, row)
                ordinal = np.arange(len(hit)) - first + np.where(row == w.rows[0], count, 0)
                count = count + len(hit) if w.goes_on else 0
                entry = at - w.own if w.goes_on else 0
                n = depth[hit]
                text = [bodies[r][s:s + m] for r, s, m in zip(row.tolist(), start.tolist(), n.tolist())]
                none = pa.nulls(len(hit), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(ordinal.astype(np.int32)),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(text, pa.string()), none,
                     none.cast(pa.bool_())], names)
                if claims:
                    on = path
                    keys = prefixes.keys(on, depth[on])
                    for flag in (False, True):
                        mine = pa.array(np.unique(keys[ends[on] == flag]).view(np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.nulls(len(mine), b.schema.field(0).type), *[pa.nulls(len(mine), t) for t in
                             (pa.int32(), pa.int32(), pa.int32(), pa.string())], mine, pa.array([flag] * len(mine), pa.bool_())],
                            names)

    names = ["_keys", *[f.name for f in _KIND]]
    return docs.mapInArrow(run, T.StructType([T.StructField("_keys", docs.schema["_keys"].dataType), *_KIND]))


def find_all_walk(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] = "doc_id", text: str = "text",
                  alias=None, node_limit: int = NODE_LIMIT) -> DataFrame:
    """M2 for any dictionary: ``<key>, ordinal, start, end, length, text, replacement_id``.

    Equals ``search.find_all`` in walk mode, without its limits on the number of
    patterns and their length. Rows with null or repeated keys are walked by
    themselves; null and empty texts have no matches.
    """
    given = _keys(key)
    act = written(active_dictionary(dictionary, alias), "active")
    st = act.agg(F.max(F.length("pattern")).alias("longest"), F.sum(F.length("pattern")).alias("nodes")).first()
    docs = df.select(F.struct(*given).alias("_keys"), F.col(text).alias("_text"))
    spark = df.sparkSession
    longest, nodes = st["longest"] or 0, prefix_keys(act)
    if not longest:
        found = _walk(docs.limit(0), lambda: (KeySet(NONE), KeySet(NONE)), 1, False)
    elif st["nodes"] <= node_limit:
        got = nodes.toArrow()  # at most node_limit rows
        keys, ends = got.column("key").to_numpy().view(np.uint64), got.column("ends").to_numpy()
        shared = spark.sparkContext.broadcast((keys, keys[ends]))
        found = _walk(docs, lambda: tuple(map(KeySet, shared.value)), longest, False)
    else:
        found = _verified(docs, written(nodes, "prefixes"), longest)
    named = found.where("start IS NOT NULL").join(
        act.select(F.col("pattern").alias("text"), F.col("replacement_id").cast("int").alias("replacement_id")), "text")
    return named.select(
        *[F.col("_keys").getField(k).alias(k) for k in given], "ordinal", "start",
        (F.col("start") + F.col("length")).alias("end"), "length", "text", "replacement_id")


def _verified(docs: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """The walk with Bloom filters of the prefixes, repeated until what it relied on is right."""
    context = docs.sparkSession.sparkContext
    whole = nodes.where("ends")
    n = [x.count() for x in (nodes, whole)]
    words = context.broadcast(tuple(bloom_words(x.select("key"), m) for x, m in zip((nodes, whole), n)))
    wrong = (NONE, NONE)
    while True:
        apart = context.broadcast(wrong)
        found = written(_walk(docs, lambda: tuple(map(Bloom, words.value, apart.value)), longest, True), "walk")
        claims = found.where("key IS NOT NULL").select("key", F.col("ends").alias("claimed")).distinct()
        # a false claim: no prefix at all, or the end of no pattern
        false = claims.join(nodes, "key", "left").where("ends IS NULL OR claimed AND NOT ends").select(
            "key", F.col("ends").isNull().alias("no_prefix"), "claimed").toArrow()
        if not false.num_rows:
            return found
        keys = false.column("key").to_numpy().view(np.uint64)
        none, claimed = (false.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("no_prefix", "claimed"))
        wrong = (np.union1d(wrong[0], keys[none]), np.union1d(wrong[1], keys[claimed]))
