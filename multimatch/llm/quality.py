"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes ``FEATURES`` numbers. Cyclic boosting visits the features in
turn and fits a shallow tree on one feature's bins at a time, so the sum of a
feature's trees is a lookup table over its bins; the same is then done over the
bin grids of the most promising feature pairs. A score is the logistic of the
intercept and one table entry per feature and pair, added bin by bin in numpy.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows (those of
smallest hash); features and scores cover every row in tasks.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 20_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 12
RATE, MIN_ROWS, RIDGE = 0.15, 15, 1.0

# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line break, 6 sentence mark,
# 7 quote or dash, 8 bracket, 9 symbol, 10 non-ASCII, 11 control
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
                             b"\n\r", b".,;:?", b"'\"-", b"()[]{}<>", b"|#$%&*@^~+=_/\\`!"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
_CLASS[[*range(9), 11, 12, *range(14, 32), 127]] = 11
_NO_LETTER = bytes(b for b in range(128) if not 97 <= b | 32 <= 122)

FEATURES = ("log_bytes", "log_words", "lower", "upper", "digit", "space", "line_break", "sentence_mark", "quote",
            "bracket", "symbol", "non_ascii", "control", "word_length", "longest_word", "distinct_words",
            "top_word", "short_words", "long_words", "words_without_letter", "capital_words", "symbol_words",
            "lines", "distinct_lines", "line_length", "closed_lines", "adjacent_repeats", "distinct_pairs")


def features(text: bytes | None) -> list[float]:
    """The numbers of a whole text; a null or empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    kind = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=12) / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    count = Counter(words)
    bare = sum(c for x, c in count.items() if not x.translate(None, _NO_LETTER))
    capital = sum(c for x, c in count.items() if len(x) > 1 and x.isupper())
    marked = sum(c for x, c in count.items() if _CLASS[x[-1]] == 9 or _CLASS[x[0]] == 9)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    return [np.log1p(n), np.log1p(len(words)), *kind[1:12].tolist(), float(sizes.mean()), float(np.log1p(sizes.max())),
            len(count) / w, (max(count.values()) / w) if count else 0.0, float((sizes <= 3).sum()) / w,
            float((sizes >= 12).sum()) / w, bare / w, capital / w, marked / w,
            np.log1p(len(lines)), len(set(lines)) / m, np.log1p(n / m),
            sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / m,
            sum(a == b for a, b in zip(words, words[1:])) / w, pairs]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, x``: the features of every row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                flat = np.array([features(t) for t in part.column(1).to_pylist()], np.float64).ravel()
                x = pa.FixedSizeListArray.from_arrays(pa.array(flat), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), x], ["id", "x"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, x array<double>")


def shallow_tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton steps per bin of a tree with up to ``leaves`` leaves over ordered bins."""
    g, h, c = (np.concatenate([[0], np.cumsum(x)]) for x in (grad, hess, rows))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p in parts:
            cut = np.arange(p[0] + 1, p[1])
            cut = cut[(c[cut] - c[p[0]] >= MIN_ROWS) & (c[p[1]] - c[cut] >= MIN_ROWS)]
            if cut.size:
                gain = worth(p[0], cut) + worth(cut, p[1]) - worth(*p)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), p, int(cut[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(grad))
    for a, b in parts:
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return step


def grid_tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """The better of: a cut on one axis, then one on the other in each half; and its gain."""
    best = (np.zeros_like(grad), 0.0)
    for flip in (False, True):
        g, h, c = (x.T if flip else x for x in (grad, hess, rows))
        half = shallow_tree(g.sum(1), h.sum(1), c.sum(1), 2)
        cut = np.flatnonzero(np.diff(half)) + 1
        step = np.zeros_like(g)
        for a, b in zip([0, *cut], [*cut, len(g)]):
            step[a:b] = shallow_tree(g[a:b].sum(0), h[a:b].sum(0), c[a:b].sum(0), 2)
        gain = float((step * g - step ** 2 * h / 2).sum())
        if gain > best[1]:
            best = (step.T if flip else step, gain)
    return best


@dataclass
class AdditiveModel:
    """Intercept, bin edges, one table per feature and one grid per feature pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    grids: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        """Fit on features and labels in 0..1; without rows every score is a half."""
        if not len(y):
            return cls()
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(float(np.log(prior / (1 - prior))))
        cuts = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n))
        model.edges = [cuts(v, BINS) for v in x.T]
        model.pair_edges = [cuts(v, PAIR_BINS) for v in x.T]
        bins = [np.searchsorted(e, v, side="right") for e, v in zip(model.edges, x.T)]
        coarse = [np.searchsorted(e, v, side="right") for e, v in zip(model.pair_edges, x.T)]
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        raw = np.full(len(y), model.intercept)

        def sums(at, size):
            p = 1 / (1 + np.exp(-raw))
            return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size), np.bincount(at, minlength=size)

        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                step = RATE * shallow_tree(*sums(b, len(model.tables[f])))
                model.tables[f] += step
                raw += step[b]
        gains = {}
        weight = [float(np.abs(t[b]).mean()) for t, b in zip(model.tables, bins)]
        strong = sorted(range(len(bins)), key=lambda f: -weight[f])[:14]
        size = [len(e) + 1 for e in model.pair_edges]
        place = lambda i, j: coarse[i] * size[j] + coarse[j]
        for i, j in combinations(sorted(strong), 2):
            s = [v.reshape(size[i], size[j]) for v in sums(place(i, j), size[i] * size[j])]
            gains[i, j] = grid_tree(*s)[1]
        for i, j in sorted(gains, key=lambda k: -gains[k])[:PAIRS]:
            model.grids[i, j] = np.zeros((size[i], size[j]))
        for _ in range(PAIR_ROUNDS):
            for (i, j), grid in model.grids.items():
                at = place(i, j)
                step = RATE * grid_tree(*[v.reshape(grid.shape) for v in sums(at, grid.size)])[0]
                grid += step
                raw += step.ravel()[at]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row of features."""
        raw = np.full(len(x), self.intercept)
        for edge, table, v in zip(self.edges, self.tables, x.T):
            raw += table[np.searchsorted(edge, v, side="right")]
        for (i, j), grid in self.grids.items():
            raw += grid[np.searchsorted(self.pair_edges[i], x[:, i], side="right"),
                        np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-raw))


def bucket_of(id_col: str, buckets: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % buckets


def learn(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> AdditiveModel:
    """Fit on the labelled rows of a feature table, ``SAMPLE`` at most.

    Rows without a label or features teach nothing; several labels of one id are averaged.
    """
    marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y")))
    rows = table.join(marks, "id").select("x", "y", F.xxhash64("id", "x").alias("h"))
    got = rows.orderBy("h").limit(SAMPLE).toArrow().combine_chunks()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(got) else \
        np.empty((0, len(FEATURES)))
    return AdditiveModel.fit(x, got.column("y").to_numpy())


def score_table(table: DataFrame, model: AdditiveModel) -> DataFrame:
    """``id, score`` of every row of a feature table."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], ["id", "score"])

    return table.mapInArrow(run, f"id {table.schema['id'].dataType.simpleString()}, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labelled rows not held out.

    Null and empty texts are scored from features of zero; repeated rows are each
    scored; without labels every score is a half; rows with a null id are scored
    and never learned from; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    table = materialise(feature_table(docs), "features")
    model = learn(table, labels.where(bucket_of("doc_id", 4) != 2))
    out = score_table(table, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(bucket_of("id", 4) == 2, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
