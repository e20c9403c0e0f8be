"""Incremental search of files as they land, each file once.

A Structured Streaming file source remembers which files it has processed in
its checkpoint, so each run (``trigger(availableNow=True)``) searches only the
files that arrived since the last one and appends their matches to the sink.
``find_all`` is a stateless projection + generator, so it runs unchanged on a
stream; the running sum of token lengths is an in-row array expression, which
streams allow (a window over rows would not be).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.anchor import find_candidates, resolve_overlaps
from ..operators.dictionary import CompiledDictionary, valid_rows
from ..operators.rewrite import replace_all
from ..operators.search import find_all
from ..sources.corpus import FILE_SCHEMA, decode_bom, reencode
from ..sources.sinks import _names


def match_stream(spark: SparkSession, source: str, schema: StructType | str, cd: CompiledDictionary,
                 key: str | Sequence[str], text: str = "text", mode: str = "retry",
                 fmt: str = "parquet") -> DataFrame:
    """A streaming match table over a directory of ``fmt`` files with ``schema``."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return find_all(stream, cd, key, text, mode)


def file_stream(spark: SparkSession, source: str, glob: str | None = None) -> DataFrame:
    """A stream of the raw files below ``source``, decoded by byte order mark: ``path, charset, bom, text``."""
    reader = spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return decode_bom(reader.load(source)).select("path", "charset", "bom", "text")


def match_file_stream(spark: SparkSession, source: str, cd: CompiledDictionary, mode: str = "retry",
                      glob: str | None = None) -> DataFrame:
    """The match table of raw files as they land, keyed by path."""
    return find_all(file_stream(spark, source, glob), cd, "path", "text", mode)


def rewrite_file_stream(spark: SparkSession, source: str, cd: CompiledDictionary, mode: str = "retry",
                        glob: str | None = None, **kw) -> DataFrame:
    """Changed files as they land, rewritten and encoded as they were: ``path, content, n_matches``."""
    out = replace_all(file_stream(spark, source, glob), cd, ["path", "charset", "bom"], "text", mode=mode, **kw)
    return reencode(out.where("n_matches > 0")).select("path", "content", "n_matches")


def run_once(matches: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything that has arrived, append to ``sink``, then stop."""
    q = (matches.writeStream.format(fmt).outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _parts(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the committed parts ``name=N`` of a folder."""
    return sorted(int(n.split("=")[1]) for n in _names(spark, folder)
                  if n.startswith(f"{name}=") and "_SUCCESS" in _names(spark, f"{folder}/{n}"))


def _put(df: DataFrame, path: str) -> None:
    """Write a part; written again, it is the same part."""
    df.write.mode("overwrite").parquet(path)


def scan_arrivals(spark: SparkSession, source: str, schema: StructType | str, dictionary: DataFrame, root: str,
                  key: str, text: str = "text", fmt: str = "parquet") -> None:
    """X1 with a dictionary of any size that may grow: search what is new, then stop.

    New is every file below ``source`` that no earlier call has seen, searched for
    all lines, and every line (``line_no, pattern``) that no earlier call had,
    searched for in the files of earlier calls. Lines taken out later stay.

    What is kept under ``root`` are occurrences, overlapping ones included, as each
    line's do not depend on the other lines: ``arrived_matches`` resolves them. A
    batch of files and a set of lines are each written as one part under their own
    number, the batch's id or the set's, so that a batch that is replayed after a
    failure changes nothing.
    """
    root = root.rstrip("/")
    sets, batches = _parts(spark, f"{root}/lines", "set"), _parts(spark, f"{root}/files", "batch")
    given = valid_rows(dictionary).select("line_no", "pattern", "replacement", "replacement_id")
    known = spark.read.parquet(f"{root}/lines") if sets else None
    new = given.join(known.select("line_no", "pattern"), ["line_no", "pattern"], "left_anti") if sets else given
    if new.limit(1).count():
        number = sets[-1] + 1 if sets else 0
        _put(new.withColumn("upto", F.lit(batches[-1] if batches else -1)), f"{root}/lines/set={number}")
    every = spark.read.parquet(f"{root}/lines")

    def occurrences(docs: DataFrame, lines: DataFrame) -> DataFrame:
        return find_candidates(docs, lines, key, text, drop_shadowed=False)

    # sets of lines whose search of earlier files was not finished
    done = _parts(spark, f"{root}/occurrences", "set")
    for number in [n for n in _parts(spark, f"{root}/lines", "set") if n not in done]:
        lines = spark.read.parquet(f"{root}/lines/set={number}")
        upto = lines.agg(F.max("upto")).first()[0]
        old = [f"{root}/files/batch={b}" for b in _parts(spark, f"{root}/files", "batch") if b <= upto]
        if old:
            paths = [r["path"] for r in spark.read.parquet(*old).select("path").distinct().collect()]  # file names
            docs = spark.read.schema(schema).format(fmt).load(paths)
            _put(occurrences(docs, lines.drop("upto")), f"{root}/occurrences/set={number}")

    def batch(docs: DataFrame, number: int) -> None:
        _put(occurrences(docs.drop("_path"), every.drop("upto", "set")), f"{root}/occurrences/batch={number}")
        _put(docs.select(F.col("_path").alias("path")).distinct(), f"{root}/files/batch={number}")

    stream = spark.readStream.schema(schema).format(fmt).load(source).withColumn("_path", F.col("_metadata.file_path"))
    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def arrived_matches(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The match table of everything ``scan_arrivals`` has searched, as ``find_all`` in retry mode gives it.

    A pattern that several lines have belongs to the first. Keys tell documents apart.
    """
    root = root.rstrip("/")
    parts = [f"{root}/occurrences/{name}={n}" for name in ("set", "batch") for n in _parts(spark, f"{root}/occurrences", name)]
    found = spark.read.parquet(*parts)
    first = F.min(F.struct("line_no", "replacement_id")).alias("l")
    found = found.groupBy(key, "start", "length", "text").agg(first).select(
        key, "start", "length", "text", F.col("l.replacement_id").alias("replacement_id"))
    return resolve_overlaps(found, key)
