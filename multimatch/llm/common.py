"""Helpers shared by the training-data operators: written tables, union-find, components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can read again, so a lost
    executor costs a re-read and never a re-computation of Python stages. The
    shuffle files of the write are removed when it ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches that gives the memory it used back to the system when it ends.

    A worker that waits for its next task would otherwise keep it, beside the
    memory of the stage that runs then.
    """
    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
    return tidied


SLOT_BITS = 27  # a slot set is 16 MB at most, whatever it was made from


def slot_set(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the low ``SLOT_BITS`` bits of an integer column, as 64-bit words.

    A value that is absent may share a slot with one that is there, never the
    other way round: a filter to be followed by an exact join. The driver
    receives one row per word set, ``2 ** (SLOT_BITS - 6)`` at most.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    rows = df.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << (SLOT_BITS - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def in_slots(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values (64-bit integers) may be in a ``slot_set``."""
    slot = values.astype(np.int64).view(np.uint64) & np.uint64((1 << SLOT_BITS) - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def union_pairs(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find step in place: join the classes of ``a[i]`` and ``b[i]``.

    ``label`` maps every node to its root and is fully compressed before and after.
    """
    while a.size:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``edges(u, v)``; component = smallest node.

    Alternating large-star and small-star rounds: each is a minimum per node
    (combined before the shuffle, so a hub costs one row per task) and an equi
    join on the node (which adaptive execution splits for a hub). The edge set
    of a round is written to the shared folder; the only values the driver sees
    are its row count and checksum. Every path gets shorter by a constant factor in
    a round or a few, so the rounds grow with the logarithm of the longest path
    (its square at worst); they go on until the edges stay as they are. Null ends
    and self loops are dropped; an empty input gives an empty result.
    """
    e = (edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = materialise(e, "edges")
    check = F.struct(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
    seen = e.select(check.alias("c")).first()["c"]
    settled = not seen["n"]
    while not settled:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = (both.where("v > u").join(low, "u")
               .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (big.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        e = materialise(small, "edges")
        now = e.select(check.alias("c")).first()["c"]
        settled, seen = now == seen, now
    # a settled edge set is a forest of stars: every u hangs directly on its smallest node
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
