"""SimHash near-duplicates through pivot distance tables.

Every text gets a 64-bit majority fingerprint over its word shingles. Distinct
fingerprints within ``max_bits`` differing bits are linked:

* *Pivot table.* The Hamming distances of a fingerprint to ``N_REFS`` fixed
  reference fingerprints are computed once per fingerprint. By the triangle
  inequality two fingerprints within ``max_bits`` differ by at most that much in
  every coordinate, so a pair whose largest coordinate difference exceeds it is
  discarded; the survivors are verified bit by bit.
* *Which pairs meet.* Comparing every pair of tables is quadratic. The bits are
  cut into ``max_bits + 2`` bands; two fingerprints within ``max_bits`` bits
  agree on at least two bands (references that live inside those bands are at
  equal distance), so only fingerprints sharing a pair of bands meet. This loses
  no pair.
* *Hot bands.* A band pair shared by more than ``BLOCK`` fingerprints is cut into
  blocks by hash, and block pairs are compared in tasks of their own. Tasks
  report a spanning forest of the links they find, never all pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, tidy, union_pairs

N_REFS = 16
BLOCK = 2048
SEED = 42
LANE = (256 * np.arange(8)).astype(np.uint16)
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, words: int) -> int:
    """Majority fingerprint (signed 64-bit) of the XXH64 hashes of a text's word shingles.

    ASCII letters are lower-cased; words are runs outside space and 0x09-0x0D; a
    text of fewer than ``words`` words is one shingle; no words (null, empty or
    blank text) give 0. A bit is 1 if set in more than half of the hashes.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_digest
    if len(tokens) <= words:
        digests = digest(joined, SEED)
    else:
        at = list(accumulate([len(t) + 1 for t in tokens], initial=0))
        digests = b"".join([digest(joined[a:b - 1], SEED) for a, b in zip(at, at[words:])])
    # a histogram of each of the eight bytes says how often each bit is set
    lanes = np.frombuffer(digests, np.uint8).reshape(-1, 8) + LANE
    seen = np.bincount(lanes.ravel(), minlength=8 * 256).reshape(8, 256)
    bits = (2 * (seen @ BYTE_BITS)[::-1].ravel() > len(lanes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = 4) -> DataFrame:
    """``id, text_hash, fp`` per row of ``docs`` (text_hash: xxhash64 of the text)."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                      F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), words) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["id", "text_hash", "fp"])

    schema = f"id {src.schema['id'].dataType.simpleString()}, text_hash bigint, fp bigint"
    return src.mapInArrow(tidy(run), schema)


def band_keys(fp: Column, max_bits: int) -> Column:
    """The keys of every pair of the ``max_bits + 2`` bands, as an array of longs."""
    n = max_bits + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    band = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
            for lo, hi in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(k), band[i], band[j])
                     for k, (i, j) in enumerate(combinations(range(n), 2))])


def references(n: int = N_REFS) -> np.ndarray:
    """Fixed reference fingerprints, from the hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def forest(run: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Class label of each row among rows of the same (contiguous) run within ``max_bits``."""
    table = [np.bitwise_count(fp ^ r).astype(np.int8) for r in references()]
    label = np.arange(len(fp))
    i, step = np.arange(len(fp)), 1
    while True:
        i = i[i + step < len(fp)]
        i = i[run[i] == run[i + step]]
        if not i.size:
            return label
        c = i
        for column in table:
            c = c[np.abs(column[c] - column[c + step]) <= max_bits]
        c = c[np.bitwise_count(fp[c] ^ fp[c + step]) <= max_bits]
        union_pairs(label, c, c + step)
        step += 1


def link_forest(fps: DataFrame, max_bits: int) -> DataFrame:
    """``u, v``: a spanning forest of the links between the distinct ``fp`` of ``fps``."""
    keyed = fps.select("fp", F.explode(band_keys(F.col("fp"), max_bits)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(shared, "key").select(
        "key", "fp", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("run"), "fp")
    rows = rows.repartition("run").sortWithinPartitions("run", "fp")

    def emit(run, fp):
        label = forest(run, fp, max_bits)
        hit = np.flatnonzero(label != np.arange(len(label)))
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[hit]), pa.array(signed[label[hit]])], ["u", "v"])

    def links(batches):
        run, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            run = np.concatenate([run, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            # the last run may go on in the next batch: keep it back
            cut = int(np.searchsorted(run, run[-1])) if len(run) else 0
            if cut:
                yield emit(run[:cut], fp[:cut])
                run, fp = run[cut:], fp[cut:]
        if len(run):
            yield emit(run, fp)

    return rows.mapInArrow(tidy(links), "u bigint, v bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = 4, max_bits: int = 4) -> DataFrame:
    """``id, text_hash, fp, root, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits, the row's own included. Null and blank texts
    have fingerprint 0 and link like any other. Null ids are carried but never
    chosen as a component's id (a component of null ids alone has a null one);
    repeated rows are returned as often as they come; other columns are ignored;
    an empty table gives an empty result. ``root`` is the component's smallest
    fingerprint, which names it even where all its ids are null.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = fps.groupBy("fp").agg(F.min("id").alias("first_id"))
    parts = connected_components(link_forest(classes.select("fp"), max_bits))
    classes = (classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", "first_id", F.coalesce("component", "fp").alias("root")))
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = materialise(classes.join(smallest, "root").select("fp", "root", "component_id"),
                        "simhash-class")
    return fps.join(by_fp, "fp").select("id", "text_hash", "fp", "root", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each component of ``simhash_groups``.

    The one with the smallest id stays (null ids last; among rows of equal id the
    one with the smallest text hash, then the smallest row in column order).
    Columns are those of ``docs``.
    """
    groups = simhash_groups(docs, id_col, text_col, words, max_bits)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("f")
    stay = groups.groupBy("root").agg(first).select("f.id", "f.text_hash")
    # repeated rows collapse before the shuffle; what stays is then chosen by key
    rows = (docs.groupBy(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash"))
                .agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("__row")))
    kept = rows.join(stay, rows["__id"].eqNullSafe(stay["id"]) & (rows["__hash"] == stay["text_hash"]),
                     "left_semi")
    return kept.select("__row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, at most 4 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs, words=4, max_bits=4).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")
