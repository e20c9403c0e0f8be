"""Alignment of two tokenizers' tokens by merge-path partitioning.

The texts of a run are tokenized by A and by B; the byte offsets at which tokens
end are two sorted sequences over the run's bytes, and merging them aligns it:
between two neighbouring ends of the merged sequence exactly one token of A and
one of B overlap (a *link*), and where both end a *group* is cut. Every document
ends in such a cut, so one merge serves all documents of a run whatever their
lengths.

The merge is divided by diagonals: the first ``d`` merged ends hold ``i`` of A and
``d - i`` of B, found by binary search along the diagonal. Diagonals ``PIECE`` apart
give pieces of equal work that know where they start and need nothing of each
other; all pieces advance together, one vector step at a time, and emit their
overlaps and the cuts they meet. A group that goes on from one piece to the next
is put together by the running number of cuts in the pieces before.

Corpus-wide, links are counted by id pair: within a document, then in a task, then
by Spark. Pairs with at least one link in ``SHARED``, of which there can be no more
than ``SHARED``, are looked up in the tasks; links of rarer pairs are joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .pieces import DEFAULT_MODEL
from .repeats import runs
from .tokenbin import DEFAULT_FILE
from .wordids import ByteBpe, Pieces, Words, remembered, utf8

PIECE = 64
SHARED = 4_000_000
FLUSH = 2_000_000  # id pairs that a task counts at a time
B_IDS = 1 << 20  # an id pair is one number: a * B_IDS + b; vocabularies are smaller


def diagonal(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` merged elements come from ``a`` (which goes first where both are equal)."""
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while True:
        going = low < high
        if not going.any():
            return low
        mid = (low + high) // 2
        more = np.zeros(len(d), bool)
        more[going] = a[mid[going]] <= b[d[going] - 1 - mid[going]]
        low = np.where(going & more, mid + 1, low)
        high = np.where(going & ~more, mid, high)


def merge_pieces(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """Merge two increasing sequences of ends, piece by piece.

    Per merged element, in order: the tokens of A and of B at work before it,
    whether it is B's end, whether it closes an overlap (no cut), and its group.
    """
    total = len(a) + len(b)
    starts = np.arange(0, total, piece)
    i = diagonal(a, b, starts)
    j = starts - i
    before = np.maximum(np.where(i > 0, a[i - 1], 0), np.where(j > 0, b[j - 1], 0)) if total else starts
    beyond = np.full(piece + 1, np.iinfo(np.int64).max)
    a, b = np.concatenate([a, beyond]), np.concatenate([b, beyond])
    shape = (piece, len(starts))
    at_a, at_b = np.empty(shape, np.int32), np.empty(shape, np.int32)
    of_b, overlap = np.empty(shape, bool), np.empty(shape, bool)
    for k in range(piece):
        end_a, end_b = a[i], b[j]
        at_a[k], at_b[k] = i, j
        of_b[k] = end_b < end_a
        end = np.minimum(end_a, end_b)
        overlap[k] = end > before
        before = end
        i = i + ~of_b[k]
        j = j + of_b[k]
    # the last piece ends early
    at_a, at_b, of_b, overlap = (x.T.reshape(-1)[:total] for x in (at_a, at_b, of_b, overlap))
    cuts = np.concatenate([~overlap, np.zeros(-total % piece, bool)]).reshape(-1, piece)
    earlier = np.cumsum(cuts.sum(axis=1)) - cuts.sum(axis=1)  # cuts in the pieces before
    group = (earlier[:, None] + np.cumsum(cuts, axis=1) - cuts).reshape(-1)[:total]
    return at_a, at_b, of_b, overlap, group


class Aligned:
    """The alignment of a run of documents: token ids of A and B, tokens per document (some have none)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ends_a: np.ndarray,
                 ends_b: np.ndarray):
        docs = len(n_a)
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        at_a, at_b, of_b, overlap, group = merge_pieces(ends_a, ends_b)
        owner = np.repeat(np.arange(docs, dtype=np.int32), n_a)
        cut = ~overlap
        # a cut is B's end after A's equal one
        self.doc_of_group = owner[at_a[cut] - 1]
        self.end_a, self.end_b = at_a[cut], at_b[cut] + 1
        self.group_a, self.group_b = group[~of_b], group[of_b]
        self.link_a, self.link_b = at_a[overlap], at_b[overlap]
        self.link_doc = owner[self.link_a]
        self.n_groups = np.bincount(self.doc_of_group, minlength=docs)
        self.n_links = np.bincount(self.link_doc, minlength=docs)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of every document in order: pair, links, and pairs per document."""
        key = self.a[self.link_a].astype(np.int64) * B_IDS + self.b[self.link_b]
        key += self.link_doc.astype(np.int64) * (B_IDS * B_IDS)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        key, links = key[first], np.diff(np.concatenate([first, [len(key)]]))
        return key % (B_IDS * B_IDS), links, np.bincount(key // (B_IDS * B_IDS), minlength=len(self.n_a))

    def texts(self, table: list[str]) -> list[str]:
        """Each document's groups, ``a1,a2|b1;a3|b2,b3``; ``table[4 * id + k]`` is the id and separator ``k``."""
        none = np.zeros(1, np.int64)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        mark = np.zeros(len(self.a), np.int64)
        mark[self.end_a - 1] = 1  # a group's last token of A
        code[np.arange(len(self.a)) + np.concatenate([none, self.end_b])[self.group_a]] = self.a.astype(np.int64) * 4 + mark
        mark = np.zeros(len(self.b), np.int64)
        mark[self.end_b - 1] = 2
        mark[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3  # a document's last token
        code[np.arange(len(self.b)) + self.end_a[self.group_b]] = self.b.astype(np.int64) * 4 + mark
        parts = list(map(table.__getitem__, code.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[a:z]) for a, z in zip([0, *ends], ends)]


class Tokenizers:
    """A and B with the words they have met, and the written forms of their ids."""

    def __init__(self, file: str, model: bytes):
        self.a, self.b = ByteBpe(file, plain=True), Pieces(model)
        self.words = Words([self.a, self.b], lead=True, check=True)
        most = max(len(self.a.bytes_of), len(self.b.bytes_of))
        if most > B_IDS:
            raise ValueError(f"a vocabulary of more than {B_IDS} ids")
        self.table = [f"{k}{mark}" for k in range(most) for mark in (",", "|", ";", "")]

    def align(self, texts: list) -> Aligned:
        """Align texts (bytes or None). A text whose tokens do not spell a space and the text has none."""
        whole = [utf8(t) for t in texts]
        both, spelt = self.words.encode(whole)
        good = spelt & np.array([w == t and w != b"" for w, t in zip(whole, texts)], bool)
        a, b = [(ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in both]
        return Aligned(a[0], b[0], a[1], b[1], np.cumsum(self.a.length[a[0]]), np.cumsum(self.b.length[b[0]]))


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                    pa.array(values, kind))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = DEFAULT_FILE,
                    model: str = DEFAULT_MODEL, digest: bool = False) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, groups, pairs, links``, one row per document.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3`` (``digest``: the SHA-256 of that, made
    where the text is); ``pairs`` are the distinct linked id pairs (``a * B_IDS +
    b``) and ``links`` their links. A text that is null, empty, no UTF-8 or not
    spelt by either tokenizer has zeros, an empty ``groups`` and no pairs. Repeated
    and null ids stand for documents of their own; other columns are ignored.
    """
    with open(file, encoding="utf-8") as f, open(model, "rb") as g:  # vocabularies, of bounded size
        state = docs.sparkSession.sparkContext.broadcast({"file": f.read(), "model": g.read()})
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        state_ = state.value
        both = remembered(state_, "both", lambda: Tokenizers(state_["file"], state_["model"]))
        for batch in batches:
            for at, texts in runs(batch.column(1).to_pylist()):
                out = both.align(texts)
                groups = out.texts(both.table)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                pairs, links, sizes = out.pairs()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(out.n_a), pa.array(out.n_b),
                     pa.array(out.n_groups), pa.array(out.n_links), pa.array(groups, pa.string()),
                     _lists(pairs, sizes, pa.int64()), _lists(links, sizes, pa.int64())],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                               "pairs array<bigint>, links array<bigint>")


def added(pairs: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of equal pairs added up."""
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])[:len(pairs)])
    return pairs[first], np.add.reduceat(links[order], first) if len(first) else links


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: links of every id pair in the corpus, and whether no pair of its B id has more."""
    def run(batches):
        pairs = links = np.zeros(0, np.int64)
        for b in batches:
            pairs, links = added(np.concatenate([pairs, b.column(0).flatten().to_numpy()]),
                                 np.concatenate([links, b.column(1).flatten().to_numpy()]))
            if len(pairs) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(links)], ["pair", "n"])
                pairs = links = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(links)], ["pair", "n"])

    counts = aligned.select("pairs", "links").mapInArrow(run, "pair bigint, n bigint")
    counts = counts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.expr(f"cast(pair % {B_IDS} as int)"))
    counts = materialise(counts, "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # one row per id of B's vocabulary
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def corpus_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = DEFAULT_FILE,
                 model: str = DEFAULT_MODEL, digest: bool = False, shared: int = SHARED) -> DataFrame:
    """``align_documents`` without pairs, and ``n_best, count_sum`` of every document.

    ``n_best``: links whose pair has as many links in the corpus as any pair with
    its B id; ``count_sum``: the corpus-wide links of the pairs of all its links.
    An empty table gives an empty result.
    """
    rows = align_documents(docs, id_col, text_col, file, model, digest)
    # written, so that a row keeps its number and texts are tokenized once
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(rows), "pair-counts")
    size = counts.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
    all_known = size["pairs"] <= shared
    known = counts if all_known else counts.where(F.col("n") * shared >= size["links"])
    got = known.orderBy("pair").toArrow()
    table = docs.sparkSession.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        keys, n, best = table.value
        for b in batches:
            size = pc.list_value_length(b.column(0)).to_numpy(zero_copy_only=False)
            pairs, links = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), size)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                here = keys[at] == pairs
            else:
                at, here = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
            sums = []
            for what in (best, n):
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, owner[here], links[here] * what[at[here]])
                sums.append(total)
            rest = ~here
            left = np.bincount(owner[rest], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], *map(pa.array, sums), _lists(pairs[rest], left, pa.int64()),
                 _lists(links[rest], left, pa.int64())], [*carried, "n_best", "count_sum", "pairs", "links"])

    carried = [c for c in rows.columns if c not in ("pairs", "links")]
    kind = [*rows.select(carried).schema.fields, T.StructField("n_best", T.LongType()),
            T.StructField("count_sum", T.LongType()), *rows.select("pairs", "links").schema.fields]
    found = rows.select("pairs", "links", *carried).mapInArrow(run, T.StructType(kind))
    if not all_known:
        found = materialise(found, "known-links")
        others = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
        others = others.select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("m"))
        others = others.join(counts, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("b"), F.sum(F.col("m") * F.col("n")).alias("s"))
        found = found.join(others, "row", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)),
             "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
    return found.select(*[c for c in carried if c != "row"], "n_best", "count_sum")


def op13(spark, sf_dir: str, file: str = DEFAULT_FILE, model: str = DEFAULT_MODEL) -> DataFrame:
    """Tokens, groups and links of every whole document under the two tokenizers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = corpus_links(docs, file=file, model=model, digest=True)
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.col("groups").alias("groups_sha256"))
