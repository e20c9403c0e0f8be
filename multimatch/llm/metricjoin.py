"""Embedding near-duplicates: an exact metric range join over pivot cells.

Cosine at least ``threshold`` is an angle of at most ``r``, and the angle is a
metric on the unit sphere. Pivots are chosen from a bounded sample (``SAMPLE``
vectors at most; every vector is joined, whatever the sample); a vector's home
is the cell of its nearest pivot. By the triangle inequality a vector x can lie
within r of a member of cell q only if

    angle(x, q) <= radius(q) + r   and   angle(x, q) <= angle(x, home) + 2 r,

so x is copied to exactly those cells, and each cell joins its own members with
everything it holds, independently. A large cell is cut into blocks by hash and
block pairs run apart. In high dimensions angles concentrate and most cells pass
the test: the join is then a blocked all-pairs comparison, still exact.
Identical vectors collapse to one before the join, and a block reports link
counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, union_pairs

SAMPLE = 20_000
CELL = 8192
MAX_CELLS = 4096
BLOCK = 16_384
TILE = 1 << 21  # vector pairs compared at a time


def unit_rows(column: pa.ListArray, at: np.ndarray, dim: int) -> np.ndarray:
    """Rows ``at`` of a list column as unit vectors in double precision."""
    part = column.take(pa.array(at))
    x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit vectors of the sample, each the farthest from those before it."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        far = int(nearest.argmin())
        if nearest[far] >= 1 - 1e-12:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _by_dim(batch, column: int):
    """(dimension, row numbers) of a batch, longest lists included."""
    size = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        yield int(dim), np.flatnonzero(size == dim)


def join_block(home: np.ndarray, other: np.ndarray, home_node, other_node, weight, threshold: float):
    """Links of each home row into ``other`` (weighted), and class labels over home + other."""
    n = len(home)
    links = np.zeros(n, np.int64)
    label = np.arange(n + len(other))
    step = max(1, TILE // max(1, len(other)))
    for a in range(0, n, step):
        i, j = np.nonzero(home[a:a + step] @ other.T >= threshold)
        i += a
        differ = home_node[i] != other_node[j]
        i, j = i[differ], j[differ]
        links += np.bincount(i, weights=weight[j], minlength=n).astype(np.int64)
        union_pairs(label, i, n + j)
    return links, label


def metric_links(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = 0.9) -> DataFrame:
    """``id, n_links, component_id`` for every row of ``rows``.

    Vectors link at a cosine of at least ``threshold`` (double precision);
    vectors of different length do not. A null, empty or zero vector, or one with
    null or non-finite components, links with nothing. Copies of a vector link
    with each other, so repeated rows count. ``component_id`` is the smallest id
    reachable over links, the row's own included; null ids are carried but never
    chosen. Other columns are ignored; an empty table gives an empty result.
    """
    r = math.acos(threshold) + 1e-7
    src = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes = materialise(
        src.where(usable).groupBy("vec").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("node", F.monotonically_increasing_id()), "vectors")

    total = classes.count()
    cells = max(1, min(MAX_CELLS, math.ceil(total / CELL)))
    sample = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(min(SAMPLE, 32 * cells + 256)).toArrow()
    pivots = {}
    for batch in sample.combine_chunks().to_batches():
        for dim, at in _by_dim(batch, 0):
            pivots[dim] = choose_pivots(unit_rows(batch.column(0), at, dim), cells)

    def homes(batches):
        for b in batches:
            for dim, at in _by_dim(b, 0):
                if dim in pivots:
                    angle = _angles(unit_rows(b.column(0), at, dim), pivots[dim])
                    home, far = angle.argmin(axis=1), angle.min(axis=1)
                else:  # a length the sample missed: one cell
                    home, far = np.zeros(len(at), np.int64), np.full(len(at), math.pi)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), dim, np.int32)), pa.array(home.astype(np.int32)), pa.array(far)],
                    ["dim", "cell", "far"])

    sizes = (classes.select("vec").mapInArrow(homes, "dim int, cell int, far double")
             .groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect())
    radius = {d: np.full(len(p), -np.inf) for d, p in pivots.items()}
    for s in sizes:
        if s["dim"] in pivots:
            radius[s["dim"]][s["cell"]] = s["radius"]

    def cells_of(batches):
        for b in batches:
            for dim, at in _by_dim(b, 2):
                if dim in pivots:
                    angle = _angles(unit_rows(b.column(2), at, dim), pivots[dim])
                    home = angle.argmin(axis=1)
                    near = angle.min(axis=1, keepdims=True)
                    row, cell = np.nonzero((angle <= radius[dim] + r) & (angle <= near + 2 * r))
                else:
                    home, row, cell = np.zeros(len(at), np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
                for a in range(0, len(row), 20_000):
                    i, c = row[a:a + 20_000], cell[a:a + 20_000]
                    part = b.take(pa.array(at[i]))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(i), dim, np.int32)), pa.array(c.astype(np.int32)),
                         pa.array(home[i] == c)], ["node", "n", "vec", "dim", "cell", "home"])

    kind = classes.schema["vec"].dataType.simpleString()
    # written once: the sizes of the cells and both sides of the join read it
    placed = materialise(classes.select("node", "n", "vec").mapInArrow(
        cells_of, f"node bigint, n bigint, vec {kind}, dim int, cell int, home boolean"), "placed")
    # at most one row per cell: how many blocks its members and its holdings are cut into
    held = materialise(placed.groupBy("dim", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("hb"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ob")), "cells")
    placed = placed.join(F.broadcast(held), ["dim", "cell"]).where("hb > 0")  # MAX_CELLS rows a length at most
    own, other = F.pmod(F.xxhash64("node"), F.col("hb")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("ob"))
    as_home = placed.where("home").select(
        "dim", "cell", own.cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("j"),
        "node", "n", "vec", F.lit(True).alias("home"))
    as_other = placed.select(
        "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("i"), other.cast("int").alias("j"),
        "node", "n", "vec", F.lit(False).alias("home"))

    def block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        home = table.column("home").to_numpy().astype(bool)
        node, weight = table.column("node").to_numpy(), table.column("n").to_numpy()
        vec = table.column("vec").combine_chunks()
        dim = table.column("dim")[0].as_py()
        h, o = np.flatnonzero(home), np.flatnonzero(~home)
        links, label = join_block(unit_rows(vec, h, dim), unit_rows(vec, o, dim), node[h], node[o], weight[o],
                                  threshold)
        nodes = np.concatenate([node[h], node[o]])
        count = np.concatenate([links, np.zeros(len(o), np.int64)])
        say = np.flatnonzero((count > 0) | (label != np.arange(len(label))))
        return pa.table({"node": nodes[say], "links": count[say], "peer": nodes[label[say]]})

    found = (as_home.unionByName(as_other).groupBy("dim", "cell", "i", "j")
             .applyInArrow(block, "node bigint, links bigint, peer bigint"))
    found = materialise(found, "links")
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("peer").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (classes.join(links, "node", "left").join(parts, "node", "left")
             .select("vec", "first_id", F.coalesce("component", "node").alias("root"),
                     (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_vec = materialise(known.join(smallest, "root").select("vec", "n_links", "component_id"), "vector-class")
    by_vec = by_vec.withColumnRenamed("vec", "key")
    # unusable vectors find no class and stay alone
    return src.withColumn("own", F.when(usable, F.col("vec"))).join(
        by_vec, F.col("own") == F.col("key"), "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at a cosine of at least 0.9."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return metric_links(rows, threshold=0.9).select(
        F.col("id").alias("vec_id"), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (WITH RECURSIVE r(a, b) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN pair p ON r.b = p.a)
          SELECT a, min(b) AS c FROM r GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT v.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, reach.c AS component_id, v.vec_id = reach.c AS kept
FROM v LEFT JOIN deg ON deg.a = v.vec_id LEFT JOIN reach ON reach.a = v.vec_id
"""
