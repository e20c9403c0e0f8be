"""Whitening of vectors from an exact integer covariance, by bit-sliced scatter.

Every entry ``c`` becomes the integer ``x = floor(SCALE * c) + OFFSET``. Shifted by
its dimension's smallest value it needs few bits; a task packs each of these bits,
across the rows of a batch, into 64-bit words (a *plane*). The sum of the products
of two dimensions is then ``sum 2**(a+b) * popcount(plane_a AND plane_b)`` over
their planes: word operations, and exact. A task keeps these sums as 32-bit limbs,
Spark adds the limbs of all tasks, and the driver gets one row per pair of
dimensions, a number that does not depend on the rows. There ``n * sum(xy) -
sum(x) * sum(y)`` is centred in whole numbers before anything is rounded, divided
by ``n * n`` and given to ``eigh``. The vectors are read again to be projected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 52)  # an entry of this size times SCALE leaves the integers used here
LIMBS = 5  # 32-bit limbs of a sum of products of two 63-bit numbers
COMPONENTS = 8


@dataclass
class Whitening:
    """Vectors fitted, smallest value and exact sum of every dimension (of shifted values),
    eigenvalues and unit eigenvectors (columns) by falling eigenvalue, trace of the covariance."""

    n: int
    low: np.ndarray
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    width: int  # largest shifted value


def usable(vec: Column) -> Column:
    """Whether every entry is there, finite and small enough to be scaled to an integer."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= LARGEST))
    return vec.isNotNull() & ~bad


def scaled(column: pa.Array, dim: int) -> np.ndarray:
    """The integers of a batch of vectors, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dim) + OFFSET


def plane_words(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bit planes of non-negative numbers (rows by dimensions): planes by words, dimension by dimension."""
    rows = y.shape[0]
    out = np.zeros((int(bits.sum()), -(-rows // 64) * 8), np.uint8)
    k = 0
    for d, b in enumerate(bits):
        for s in range(b):
            packed = np.packbits((y[:, d] >> s & 1).astype(np.uint8))
            out[k, :len(packed)] = packed
            k += 1
    return out.view(np.uint64)


class Scatter:
    """Sums and sums of products of shifted numbers, as limbs of 32 bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, dim = bits, len(bits)
        self.dims = np.repeat(np.arange(dim), bits)
        self.shift = np.concatenate([np.arange(b) for b in bits]) if dim else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(bits)])
        self.products = np.zeros((LIMBS, dim, dim), np.int64)
        self.sums = np.zeros((LIMBS, dim), np.int64)

    def add(self, y: np.ndarray) -> None:
        planes = plane_words(y, self.bits)
        for a in range(len(planes)):
            i, s = int(self.dims[a]), int(self.shift[a])
            count = np.bitwise_count(planes[a] & planes[a:]).sum(axis=1, dtype=np.int64)
            self.sums[s // 32, i] += count[0] << (s % 32)
            rest = int(self.first[i + 1]) - a
            count[1:rest] *= 2  # two planes of one dimension meet in both orders
            at = self.shift[a:] + s
            count <<= at % 32
            # planes of a dimension stand together; those of dimension i start here at a
            begins = np.concatenate([[0], self.first[i + 1:-1] - a])
            mine = np.concatenate([[True], self.bits[i + 1:] > 0])
            js = np.arange(i, len(self.bits))[mine]
            for limb in range(int(at.min()) // 32, int(at.max()) // 32 + 1):
                part = np.where(at // 32 == limb, count, 0)
                self.products[limb, i, js] += np.add.reduceat(part, begins[mine])
        for acc in (self.products, self.sums):
            for limb in range(LIMBS - 1):
                acc[limb + 1] += acc[limb] >> 32
                acc[limb] &= 0xFFFFFFFF

    def batch(self) -> pa.RecordBatch:
        """``i, j, l0..``: products for ``i <= j``, sums at ``j = -1``."""
        dim = len(self.bits)
        i, j = np.triu_indices(dim)
        limbs = [np.concatenate([p[i, j], s]) for p, s in zip(self.products, self.sums)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.arange(dim)]), pa.int32()),
             pa.array(np.concatenate([j, np.full(dim, -1)]), pa.int32()), *[pa.array(x) for x in limbs]],
            ["i", "j", *[f"l{k}" for k in range(LIMBS)]])


def exact_sums(src: DataFrame, low: np.ndarray, bits: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums (at ``j = -1``) and sums of products of all shifted values of ``src(vec)``."""
    dim = len(low)

    def run(batches):
        scatter, any_row = Scatter(bits), False
        for b in batches:
            if b.num_rows:
                scatter.add(scaled(b.column(0), dim) - low)
                any_row = True
        if any_row:
            yield scatter.batch()

    limbs = [f"l{k}" for k in range(LIMBS)]
    parts = src.mapInArrow(run, "i int, j int, " + ", ".join(f"{x} bigint" for x in limbs))
    got = parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in limbs]).toArrow()
    at = [got.column(c).to_pylist() for c in ["i", "j", *limbs]]
    return {(i, j): sum(v << 32 * k for k, v in enumerate(row)) for i, j, *row in zip(*at)}


def ranges(src: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integer of every dimension of ``src(vec)``."""
    def run(batches):
        lo = hi = None
        for b in batches:
            if b.num_rows:
                x = scaled(b.column(0), dim)
                lo = x.min(0) if lo is None else np.minimum(lo, x.min(0))
                hi = x.max(0) if hi is None else np.maximum(hi, x.max(0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(lo), pa.array(hi)],
                                             ["d", "lo", "hi"])

    rows = src.mapInArrow(run, "d int, lo bigint, hi bigint").groupBy("d").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").collect()
    return np.array([r["lo"] for r in rows], np.int64), np.array([r["hi"] for r in rows], np.int64)


def eigen(n: int, sums: dict[tuple[int, int], int], dim: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors of the covariance, and its trace.

    Each entry is centred as a whole number and rounded once, by the division.
    """
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * sums[i, j] - sums[i, -1] * sums[j, -1]) / (n * n)
    trace = sum(n * sums[i, i] - sums[i, -1] ** 2 for i in range(dim)) / (n * n)
    values, vectors = np.linalg.eigh(v)
    return values[::-1], vectors[:, ::-1], trace


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """``(id, vec)`` of the rows that take part, their number and their dimension."""
    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec")))
    most = (src.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.desc("dim")).first())
    if most is None:
        return src, 0, 0
    return src.where(F.size("vec") == most["dim"]), most["n"], most["dim"]


def fit(src: DataFrame, n: int, dim: int) -> Whitening:
    """Fit on all of ``src(vec)``: ``n`` vectors of one dimension."""
    if not n or not dim:
        none = np.zeros(0)
        return Whitening(n, none.astype(np.int64), [], none, np.zeros((dim, 0)), 0.0, 0)
    low, high = ranges(src, dim)
    bits = np.array([int(h - w).bit_length() for w, h in zip(low, high)], np.int64)
    sums = exact_sums(src, low, bits)
    values, vectors, trace = eigen(n, sums, dim)
    # what rounding alone can leave of a zero is no component
    rank = int(np.sum(values > max(values[0], 0) * dim * np.finfo(float).eps))
    return Whitening(n, low, [sums[d, -1] for d in range(dim)], values[:rank], vectors[:, :rank], trace,
                     int((high - low).max()))


def project(src: DataFrame, model: Whitening, k: int) -> DataFrame:
    """``id, deviation, w``: exact squared distance from the mean (times ``n * n``), whitened coordinates."""
    n, low, dim = model.n, model.low, len(model.low)
    axes, roots = model.vectors[:, :k], np.sqrt(model.values[:k])
    small = dim * (n * model.width) ** 2 < 1 << 62  # else in whole numbers of any size
    sums = np.array(model.sums, np.int64 if small else object)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = scaled(b.column(1), dim) - low
            away = n * (y if small else y.astype(object)) - sums
            w = (away.astype(np.float64) / n) @ axes / roots
            total = pa.array([str(t) for t in (away * away).sum(axis=1)])
            ends = pa.array(np.arange(b.num_rows + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), total, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["id", "deviation", "w"])

    kind = f"id {src.schema['id'].dataType.simpleString()}, deviation string, w array<double>"
    return src.mapInArrow(run, kind).withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``, one row per vector and component.

    Components are numbered from 1 by falling eigenvalue, ``k`` at most, either
    sign; a component without variance (a rank below ``k``) is left out. Rows
    whose vector is null, or holds null or non-finite entries or entries beyond
    2**52, give none, nor do vectors of another length than the most frequent one
    (of several such lengths, the largest). Repeated rows and null ids count as
    rows like any other; equal eigenvalues have any orthonormal axes; other
    columns are ignored; an empty table gives an empty result. ``deviation``, the
    sum over dimensions of ``(n * x - sum(x)) ** 2``, is a decimal of 38 digits
    (null beyond). ``identity_error`` is the largest entry of the covariance of
    the whitened values minus the identity.
    """
    src, n, dim = vectors_of(df, id_col, vec_col)
    model = fit(src.select("vec"), n, dim)
    k = min(k, len(model.values))
    wide = project(src, model, k)
    if not k:
        wide = wide.limit(0)
    else:
        wide = materialise(wide, "whitened")
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    w = [F.col("w")[a] for a in range(k)]
    error = 0.0
    if k:
        got = wide.agg(*[F.sum(x) for x in w], *[F.sum(w[a] * w[b]) for a, b in pairs]).first()
        mean = [s / n for s in got[:k]]
        error = max(abs(got[k + p] / n - mean[a] * mean[b] - (a == b)) for p, (a, b) in enumerate(pairs))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:k]]).cast("array<double>")
    return wide.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12(spark, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings (a deviation beyond a long is null)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = whiten(vectors)
    return out.withColumnRenamed("id", "vec_id").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
