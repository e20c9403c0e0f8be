"""Document scores by masked pseudo-likelihood of a small bidirectional network.

A word is a run outside space and 0x09-0x0D, known by its hash. The network's
tokens are the ``KNOWN`` most frequent words of the corpus, each for itself, and
``BUCKETS`` hash buckets of all other words. The network predicts every token
from the ``REACH`` tokens on both sides of it: their embeddings (one table per
position) are summed, squashed, and give a distribution over ``CLASSES`` frequency
classes and then one over the tokens of the class (which starts from their shares
of the corpus count). Within its bucket a word has its own share of the bucket's
count: the counts of all words, as many as the corpus has, stay a table that is
joined to the words to be scored; those of words with at least one in ``FREQUENT``
of all tokens, ``FREQUENT`` at most, are looked up in the tasks. Words not counted have ``UNSEEN`` occurrences in
all, spread evenly over the buckets. A document's score is the sum of the
log-probabilities of all its words.

All counts cover the whole corpus. Training is one pass over every token: each
task starts from the same weights, trains on its own partition in numpy, and the
tasks' weights, weighted by the tokens seen, are averaged block by block on the
executors in two steps. Only the averaged network, of fixed size, reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .repeats import runs, word_hashes

KNOWN, BUCKETS, CLASSES = 4096, 1024, 64
REACH, HIDDEN = 2, 16
BATCH, RATE = 8192, 0.1
BLOCKS, FAN_IN = 64, 32
UNSEEN = 1.0
FREQUENT = 500_000
EDGE = KNOWN + BUCKETS  # the token beyond a document's ends
TABLE = EDGE + 1


@dataclass
class Vocabulary:
    """Hashes of the known words (sorted) with their tokens; class and share of every token.

    ``log_size`` is the log count of every bucket, with its part of ``UNSEEN``;
    ``rare`` the table ``h, n`` of the words in buckets (on the driver only), ``often``
    the hashes (sorted) and log counts of the frequent ones among them.
    """

    hashes: np.ndarray
    tokens: np.ndarray
    klass: np.ndarray
    log_share: np.ndarray
    log_size: np.ndarray
    rare: DataFrame | None = None
    often: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))

    @classmethod
    def build(cls, known: list[tuple[int, int]], buckets: dict[int, int],
              rare: DataFrame | None = None) -> "Vocabulary":
        """From (hash, count) of the known words, most frequent first, and counts per bucket."""
        count = np.zeros(EDGE, np.float64)
        count[:len(known)] = [n for _, n in known]
        for b, n in buckets.items():
            count[KNOWN + b] = n
        count[KNOWN:] += UNSEEN / BUCKETS  # a word never seen has a chance too
        order = np.argsort(-count, kind="stable")
        mass = np.cumsum(count[order]) / count.sum()
        klass = np.zeros(EDGE, np.int64)
        klass[order] = np.minimum((np.concatenate([[0], mass[:-1]]) * CLASSES).astype(np.int64), CLASSES - 1)
        total = np.bincount(klass, count, CLASSES)
        h = np.array([x for x, _ in known], np.int64).view(np.uint64)
        at = np.argsort(h)
        with np.errstate(divide="ignore"):  # a place without a word has no share
            share = np.log(count / total[klass])
        return cls(h[at], at, klass, share, np.log(count[KNOWN:]), rare)

    def members(self) -> list[np.ndarray]:
        """The tokens of every class."""
        used = np.flatnonzero(np.isfinite(self.log_share))
        return [used[self.klass[used] == c] for c in range(CLASSES)]

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts (bytes), and the text each belongs to."""
        return self.words(texts)[:2]

    def words(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the texts (bytes), the text each belongs to, and the words' hashes."""
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        flat = np.frombuffer(b" ".join([t or b"" for t in texts]), np.uint8)
        h, start = word_hashes(flat)
        doc = np.searchsorted(np.cumsum(sizes + 1), start, side="right")
        token = KNOWN + (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            token = np.where(self.hashes[at] == h, self.tokens[at], token)
        return token, doc, h


def contexts(token: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The ``2 * REACH`` neighbours of every token within its text (``EDGE`` beyond it)."""
    n = len(token)
    out = np.full((2 * REACH, n), EDGE, np.int64)
    for row, off in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        a, b = max(0, -off), n - max(0, off)
        if b > a:
            here = slice(a, b)
            there = slice(a + off, b + off)
            out[row, here] = np.where(doc[there] == doc[here], token[there], EDGE)
    return out


STEEP = 40.0  # exponents that are no larger need no levelling in 32 bits


def bound(weights: np.ndarray) -> float:
    """What no product of a row of ``weights`` with a hidden state (-1 to 1 everywhere) exceeds."""
    return float(np.abs(weights).sum(axis=1).max())


def level(x: np.ndarray, most: float) -> None:
    """Take its maximum off each row, if ``most``, which no entry exceeds in size, is too large for exponentials."""
    if not most <= STEEP:
        x -= x.max(axis=1, keepdims=True)


def totals(x: np.ndarray) -> np.ndarray:
    """The sums of the rows, as a product (numpy sums short rows slowly)."""
    return x @ np.ones(x.shape[1], np.float32)


class Network:
    """Position embeddings, hidden bias, output weights and bias of classes, output weights of tokens.

    Adagrad state while training.
    """

    def __init__(self, flat: np.ndarray | None = None):
        shapes = [(2 * REACH, TABLE, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (EDGE, HIDDEN)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            flat = np.zeros(sum(sizes), np.float32)
            flat[:sizes[0]] = np.random.default_rng(7).normal(0, 0.1, sizes[0])
            flat[sum(sizes[:2]):sum(sizes[:3])] = np.random.default_rng(8).normal(0, 0.1, sizes[2])
        self.flat = np.array(flat, np.float32)
        parts = np.split(self.flat, np.cumsum(sizes)[:-1])
        self.embed, self.bias, self.out, self.out_bias, self.words = [p.reshape(s) for p, s in zip(parts, shapes)]
        self.seen = [np.full(s, 1e-2, np.float32) for s in shapes]
        self.moved = np.zeros(shapes[0], np.float32)

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        z = self.embed[0].take(ctx[0], axis=0)
        z += self.bias
        for k in range(1, 2 * REACH):
            z += self.embed[k].take(ctx[k], axis=0)
        return np.tanh(z, out=z)

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        """Logits of the classes, levelled."""
        x = hidden @ self.out
        x += self.out_bias
        level(x, bound(self.out.T) + np.abs(self.out_bias).max())
        return x

    def log_classes(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes' log-probabilities but for a number of each row's own, which is to be taken off."""
        x = self.logits(hidden)
        return x, np.log(totals(np.exp(x)))[:, None]

    def within(self, klass: np.ndarray, token: np.ndarray, members: list):
        """For tokens sorted by class: the rows of each class of more than one token, the
        places of its tokens in ``np.concatenate(members)``, and the place of each right one among them."""
        every = np.concatenate(members)
        ends = np.cumsum([len(m) for m in members])
        place = np.empty(EDGE, np.int64)
        place[every] = np.arange(len(every))
        first = np.concatenate([[0], ends[:-1]])
        right = place[token] - first[klass]
        rows = np.concatenate([[0], np.cumsum(np.bincount(klass, minlength=len(members)))])
        used = np.flatnonzero((np.diff(rows) > 0) & (ends - first > 1))
        return every, [(slice(a, z), slice(b, e), right[a:z]) for a, z, b, e in zip(
            rows[used].tolist(), rows[used + 1].tolist(), first[used].tolist(), ends[used].tolist())]

    def inner(self, hidden: np.ndarray, words: np.ndarray, share: np.ndarray, most: float) -> np.ndarray:
        """Logits of the tokens of one class, levelled; ``most`` is the bound of its words."""
        x = hidden @ words.T
        x += share
        level(x, most + np.abs(share).max())
        return x

    def log_prob(self, ctx: np.ndarray, token: np.ndarray, vocabulary: Vocabulary, members: list) -> np.ndarray:
        """Log-probability of each token given its neighbours: of its class, and of the token in it."""
        out = np.empty(len(token), np.float64)
        most = bound(self.words)
        for a in range(0, len(token), BATCH):
            order = np.argsort(vocabulary.klass[token[a:a + BATCH]].astype(np.uint8), kind="stable")
            here = token[a:a + BATCH][order]
            klass = vocabulary.klass[here]
            h = self.hidden(ctx[:, a:a + BATCH][:, order])
            x, off = self.log_classes(h)
            part = (x[np.arange(len(here)), klass] - off[:, 0]).astype(np.float64)
            every, classes = self.within(klass, here, members)
            words, share = self.words[every], vocabulary.log_share[every].astype(np.float32)
            sums = np.ones(len(here), np.float32)
            for rows, mine, right in classes:
                x = self.inner(h[rows], words[mine], share[mine], most)
                part[rows] += x[np.arange(len(right)), right]
                sums[rows] = totals(np.exp(x, out=x))
            part -= np.log(sums)
            out[a + order] = part
        return out

    def step(self, part: int, g: np.ndarray, n: int) -> None:
        """Adagrad on one of the arrays, by its summed gradient over ``n`` tokens; where it is 0 nothing moves."""
        p, s = (self.embed, self.bias, self.out, self.out_bias, self.words)[part], self.seen[part]
        g = (g * (1 / n)).astype(np.float32)
        s += g * g
        g *= np.float32(RATE)
        g /= np.sqrt(s)
        p -= g

    def train(self, ctx: np.ndarray, token: np.ndarray, vocabulary: Vocabulary, members: list) -> None:
        """One Adagrad step on the mean loss of a batch; rows without a gradient stay as they are."""
        order = np.argsort(vocabulary.klass[token].astype(np.uint8), kind="stable")  # rows of a class together
        n, token, ctx = len(token), token[order], ctx[:, order]
        klass = vocabulary.klass[token]
        h = self.hidden(ctx)
        # exponentials are not divided by their sums: the products with the weights are, which are fewer
        d = self.logits(h)
        sums = totals(np.exp(d, out=d))
        d[np.arange(n), klass] -= sums
        dh = d @ self.out.T
        dh /= sums[:, None]
        d_out, d_bias = (h / sums[:, None]).T @ d, (1 / sums) @ d
        every, classes = self.within(klass, token, members)
        words, share, most = self.words[every], vocabulary.log_share[every].astype(np.float32), bound(self.words)
        grad = np.zeros_like(self.words)
        for rows, mine, right in classes:
            x, here = self.inner(h[rows], words[mine], share[mine], most), h[rows]
            sums = totals(np.exp(x, out=x))
            x[np.arange(len(right)), right] -= sums
            dh[rows] += x @ words[mine] / sums[:, None]
            grad[every[mine]] = x.T @ (here / sums[:, None])
        dz = dh * (1 - h * h)
        columns = np.ascontiguousarray(dz.T, np.float64)
        for k in range(2 * REACH):
            for j in range(HIDDEN):
                self.moved[k, :, j] = np.bincount(ctx[k], columns[j], TABLE)
        self.step(0, self.moved, n)
        self.step(1, columns.sum(1), n)
        self.step(2, d_out, n)
        self.step(3, d_bias, n)
        self.step(4, grad, n)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``h, n``: how often each word (by hash) occurs in the corpus."""
    src = docs.select(F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")

    def run(batches):
        for b in batches:
            for _, part in runs(b.column(0).to_pylist()):
                h, n = np.unique(word_hashes(np.frombuffer(b" ".join(part), np.uint8))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return src.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def learn_vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """Count all words: the most frequent (ties: smaller hash), the buckets' totals, and a table of the others."""
    counts = materialise(word_counts(docs, text_col), "words")
    known = [(r["h"], r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(KNOWN).collect()]
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1))
    totals = {r["b"]: r["n"] for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()}
    for h, n in known:  # what is known by itself is in no bucket
        totals[h & (BUCKETS - 1)] -= n
    rare = counts
    if known:
        h, n = known[-1]
        rare = counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("h") > h)))
    vocabulary = Vocabulary.build(known, totals, rare)
    tokens = sum(n for _, n in known) + sum(totals.values())
    often = rare.where(F.col("n") * FREQUENT >= tokens).orderBy("h").toArrow()
    vocabulary.often = often.column("h").to_numpy(), np.log(often.column("n").to_numpy())
    return vocabulary


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> Network:
    """Train on every token of the corpus; an empty corpus gives the starting weights."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(replace(vocabulary, rare=None))
    src = docs.select(F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")

    def fit(batches):
        vocabulary, net, seen = shared.value, Network(), 0
        members = vocabulary.members()
        for b in batches:
            for _, part in runs(b.column(0).to_pylist()):
                token, doc = vocabulary.encode(part)
                ctx = contexts(token, doc)
                for a in range(0, len(token), BATCH):
                    net.train(ctx[:, a:a + BATCH], token[a:a + BATCH], vocabulary, members)
                seen += len(token)
        if seen:
            blocks = np.array_split(net.flat.astype(np.float64) * seen, BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([seen % FAN_IN] * BLOCKS, pa.int32()),
                 pa.array([seen] * BLOCKS, pa.int64()), pa.array(blocks, pa.list_(pa.float64()))],
                ["block", "part", "seen", "sums"])

    def add(key, table):
        sums = np.zeros(0)
        for row in table.column("sums"):
            sums = row.values.to_numpy() + sums if len(sums) else row.values.to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()),
                         "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()),
                         "sums": pa.array([sums], pa.list_(pa.float64()))})

    kind = "block int, part int, seen bigint, sums array<double>"
    weights = src.mapInArrow(fit, kind)
    # two steps, so that no task adds more than a share of the tasks' weights
    weights = weights.groupBy("block", "part").applyInArrow(add, kind)
    rows = weights.groupBy("block").applyInArrow(add, kind).orderBy("block").collect()
    if not rows:
        return Network()
    return Network(np.concatenate([np.array(r["sums"]) / r["seen"] for r in rows]))


def score(docs: DataFrame, vocabulary: Vocabulary, net: Network, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id, n_tokens, log_prob`` of every row: the summed conditional log-probabilities.

    The network's part is written with the words in buckets, whose counts are
    then joined and summed by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((replace(vocabulary, rare=None), net.flat))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        vocabulary, flat = shared.value
        net, members = Network(flat), vocabulary.members()
        for b in batches:
            for first, part in runs(b.column(1).to_pylist()):
                token, doc, h = vocabulary.words(part)
                each = net.log_prob(contexts(token, doc), token, vocabulary, members)
                rare = token >= KNOWN
                each[rare] -= vocabulary.log_size[token[rare] - KNOWN]
                h = h.view(np.int64)
                hashes, logs = vocabulary.often
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    often = rare & (hashes[at] == h)
                    each[often] += logs[at[often]]
                    rare &= ~often
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(part)))])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(part)),
                     pa.array(np.bincount(doc, minlength=len(part)), pa.int64()),
                     pa.array(np.bincount(doc, each, minlength=len(part)).astype(np.float64)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[rare]))],
                    ["id", "n_tokens", "net", "rare"])

    rows = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens bigint, net double, "
                               "rare array<bigint>")
    # written, so that a row keeps its number
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    words = rows.select("row", F.explode("rare").alias("h"))
    if vocabulary.rare is not None:
        words = words.join(vocabulary.rare, "h", "left")
    else:
        words = words.withColumn("n", F.lit(None).cast("bigint"))
    added = words.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(UNSEEN / BUCKETS)))).alias("own"))
    return rows.drop("rare").join(added, "row", "left").select(
        "id", "n_tokens", (F.col("net") + F.coalesce("own", F.lit(0.0))).alias("log_prob"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, log_prob, mean_log_prob`` of every row, by a network trained on all of ``docs``.

    A null, empty or blank text has no tokens, 0 and a null mean; repeated rows
    are trained on and scored as often as they come; null ids are carried; other
    columns are ignored; an empty table gives an empty result. Weights depend on
    how the rows are partitioned, as training is per partition.
    """
    vocabulary = learn_vocabulary(docs, text_col)
    out = score(docs, vocabulary, train(docs, vocabulary, text_col), id_col, text_col)
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def op4(spark, sf_dir: str) -> DataFrame:
    """Tokens and summed conditional log-probability of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudo_likelihood(docs).withColumnRenamed("id", "doc_id")
