"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Words are lower-cased runs outside space and 0x09-0x0D. A mask is a fixed list
of word offsets; the words it selects at a position are hashed and the others
ignored. The two ``MASKS`` together hit every 13 aligned words of which at most
two differ. Items too short for a mask are hashed whole.

Test hashes and training hashes meet in an equi join. Around each hit the item
is laid over the document and compared word by word; the overlap counts when
some ``WINDOW`` aligned words (the whole item if it is shorter, then without
tolerance) agree in at least 80 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 13
# word offsets; weight six; found by search: together complete for two substitutions in 13 words
MASKS = [(0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8)]
SPAN = max(m[-1] for m in MASKS) + 1
MAX_BROADCAST_SEEDS = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words (null and blank texts: none)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def seed_key(h: Column, at: Column, mask: tuple[int, ...]) -> Column:
    """The mask's hash at a position of a text's word hashes (null where it does not fit)."""
    return F.when(at + mask[-1] < F.size(h), F.xxhash64(
        F.lit(len(mask) * 100 + mask[-1]), *[F.get(h, at + o) for o in mask]))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, item_id, start, n_words, matched, best`` of each document and item that overlap.

    One row per document id and distinct item text (``item_id``: the smallest
    with that text): ``start`` is the document word under the item's first word
    (negative if the item begins before the document), ``matched`` the equal
    words over the item's ``n_words``, ``best`` those in the best window; the
    best alignment wins, then the one with most matches, then the leftmost.
    Null or blank texts and null item ids overlap nothing; repeated rows count
    once; rows with a null document id are reported together under null; other
    columns are ignored; an empty table gives an empty result.
    """
    tests = (items.select(F.col(item_id_col).alias("item_id"), words_of(F.col(item_text_col)).alias("item"))
             .where("item_id IS NOT NULL AND size(item) > 0")
             .groupBy("item").agg(F.min("item_id").alias("item_id")))
    # whole-item masks of the few lengths below the span (at most SPAN - 1 of them)
    short = [r["n"] for r in tests.select(F.size("item").alias("n")).where(F.col("n") < SPAN)
             .distinct().orderBy("n").collect()]
    masks = MASKS + [tuple(range(n)) for n in short]

    # positions are exploded before they are hashed, which keeps the hashing in compiled code
    place = tests.withColumn("h", F.transform("item", lambda w: F.xxhash64(w)))
    place = place.select("item_id", "item", "h", F.posexplode("h").alias("at", "own"))
    seeds = None
    for k, m in enumerate(masks):
        t = place if k < len(MASKS) else place.where(F.size("item") == len(m))
        t = t.select("item_id", "at", seed_key(F.col("h"), F.col("at"), m).alias("key")).where(
            "key IS NOT NULL")
        seeds = t if seeds is None else seeds.unionByName(t)
    seeds = seeds.select("item_id", "at", "key")
    few = seeds.count() <= MAX_BROADCAST_SEEDS
    if few:
        seeds = F.broadcast(seeds)  # beyond it Spark picks a shuffled join

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("copy"))
    train = src.select("id", "copy", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    train = train.select("id", "copy", "h", F.posexplode("h").alias("p", "own"))
    train = train.select("id", "copy", "p", F.explode(F.array(
        *[seed_key(F.col("h"), F.col("p"), m) for m in masks])).alias("key"))
    hits = train.join(seeds, "key").select("id", "copy", "item_id", (F.col("p") - F.col("at")).alias("start"))
    # where to look in each text with a hit: one row per text, item and alignment, written once
    hits = materialise(hits.distinct(), "seed-hits")
    spots = hits.groupBy("id", "copy").agg(F.collect_list(F.struct("item_id", "start")).alias("spots"))
    spots = spots.select(F.col("id").alias("i"), F.col("copy").alias("c"), "spots")
    if hits.count() <= MAX_BROADCAST_SEEDS:
        spots = F.broadcast(spots)  # beyond it Spark picks a shuffled join
    near = src.join(spots, src["id"].eqNullSafe(spots["i"]) & (src["copy"] == spots["c"]))
    near = near.dropDuplicates(["id", "copy"]).select("id", words_of(F.col("text")).alias("words"), "spots")
    # only the words under an item leave a document's row
    longest = tests.agg(F.max(F.size("item"))).first()[0] or 0
    around = F.transform("spots", lambda s: F.struct(
        s["item_id"].alias("item_id"), s["start"].alias("start"),
        F.slice("words", F.greatest(s["start"], F.lit(0)) + 1, F.lit(longest)).alias("words")))
    near = near.select("id", F.explode(around).alias("s")).select("id", "s.item_id", "s.start", "s.words")
    items_by_id = tests.select("item_id", "item")
    hits = near.join(F.broadcast(items_by_id) if few else items_by_id, "item_id")

    n = F.size("item")
    skipped = F.greatest(F.col("start"), F.lit(0))  # the words begin there
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(
        (F.when(F.col("start") + k >= 0, F.get("words", F.col("start") + k - skipped)) == F.get("item", k)),
        F.lit(False)).cast("int"))
    hits = hits.select("id", "item_id", "start", n.alias("n_words"), same.alias("same"))
    length = F.least("n_words", F.lit(WINDOW))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_words") - length + 1),
                                   lambda s: total(F.slice("same", s, length))))
    hits = hits.select("id", "item_id", "start", "n_words", total(F.col("same")).alias("matched"),
                       best.alias("best"))
    good = hits.where(F.when(F.col("n_words") < WINDOW, F.col("best") == F.col("n_words"))
                       .otherwise(F.col("best") * 5 >= WINDOW * 4))
    top = F.max(F.struct("best", "matched", (-F.col("start")).alias("left"), "n_words")).alias("t")
    return good.groupBy("id", "item_id").agg(top).select(
        "id", "item_id", (-F.col("t.left")).alias("start"), F.col("t.n_words").alias("n_words"),
        F.col("t.matched").alias("matched"), F.col("t.best").alias("best"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark item overlaps, with all their columns.

    Rows with a null id are kept unless some null-id row overlaps an item.
    """
    leaks = overlaps(docs, items, id_col, text_col).select(F.col("id").alias("__leak")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["__leak"]), "left_anti")


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap: all documents against all items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlaps(docs, items).withColumnRenamed("id", "doc_id")


OP10_SQL = r"""
WITH items AS (
  SELECT item, min(item_id) AS item_id FROM (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS item FROM benchmark)
  WHERE len(item) > 0 AND item_id IS NOT NULL GROUP BY item),
iw AS (SELECT item_id, len(item) AS n, unnest(item) AS w, unnest(range(len(item))) AS k FROM items),
dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
eq AS (SELECT DISTINCT doc_id, item_id, n, p - k AS start, k FROM dw JOIN iw USING (w)),
many AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, start) AS matched FROM eq),
win AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY k
                                 RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS best
        FROM many WHERE matched >= least(n, 11)),
al AS (SELECT doc_id, item_id, start, n, matched, max(best) AS best FROM win GROUP BY ALL),
good AS (SELECT * FROM al WHERE CASE WHEN n < 13 THEN best = n ELSE best * 5 >= 52 END)
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(n AS INT) AS n_words,
       CAST(matched AS INT) AS matched, CAST(best AS INT) AS best
FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, matched DESC, start) = 1
"""
