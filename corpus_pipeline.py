"""Corpus pipeline: the stages a raw document table goes through to become training ids.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that ``run`` writes as Parquet under the shared
checkpoint folder and hands to the next stage. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multimatch.llm.common import materialise
from multimatch.llm.decontaminate import decontaminate
from multimatch.llm.langid import identify, learn_from
from multimatch.llm.pieces import encode_documents, read_model
from multimatch.llm.repeats import remove_repeats
from multimatch.llm.simhash import simhash_dedup

MIN_LANGUAGE_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those of whose trigrams no language has a fifth.

    If no language could be learned (no row to learn from has a lang and a text
    with a letter), every document with a letter stays. Null and empty texts go;
    repeated rows are each judged, alike; null ids count as rows to learn from; an
    empty table stays empty.
    """
    filters = learn_from(docs)
    if not filters.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, filters)
    return found.where((F.col("__lang") != "und") & (F.col("__lang_score") >= MIN_LANGUAGE_SCORE)).drop(
        "__lang", "__lang_score")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (4-word shingles, 4 bits).

    The one with the smallest id: null ids last, ties by text hash, then by the
    row; of a repeated row one stays. Null, empty and blank texts are one group. An
    empty table stays empty, and other columns take no part.
    """
    return simhash_dedup(docs, words=4, max_bits=4)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages of 13 words or more that an earlier document has.

    A text that loses nothing stays as it is; one that loses some words becomes
    the words left, joined by one space; one that loses all of them goes. Rows
    with a null id or of one id lose nothing to each other; null and empty texts
    have no words and stay. An empty table stays empty.
    """
    out = remove_repeats(docs)
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    stay = out.where((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_words")))
    return stay.select(*[(text if c == "text" else F.when(F.col("__n_removed") > 0, F.length("__kept"))
                          .otherwise(F.col("n_chars")).cast("long") if c == "n_chars" else F.col(c)).alias(c)
                         for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Null and empty texts overlap nothing, nor do items that are null or too short;
    repeated rows go or stay alike. An empty table, of either kind, changes nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the document table, the SentencePiece ids, and whether they decode to the text.

    Columns ``ids``, ``n_ids`` and ``round_trip`` of the table are replaced. Null
    and empty texts have no ids; repeated rows are each encoded; an empty table
    gives an empty result.
    """
    out = encode_documents(docs.drop("ids", "n_ids", "round_trip"), read_model())
    return (out.withColumn("n_ids", F.size("__ids").cast("long"))
            .withColumn("round_trip", F.col("__decoded") == F.coalesce("text", F.lit("")))
            .withColumnRenamed("__ids", "ids").drop("__decoded"))


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", simhash_stage),
    ("substring dedup", repeats_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

# fingerprints, components and tokenisation have no SQL equivalent
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
