"""Corpus sources: tables with a text column, file sets, BOM decoding, unions.

S1: file arguments become ``binaryFile`` scans (``recursive=True`` reads every
file below a directory, on a mounted file system listed and read by the tasks:
Spark's file index keeps every file in the driver's memory); very large files
are read line by line instead (``read_lines``); tables are read with only the key and text columns, so the
parquet scan prunes everything else.
S2: a file's encoding is chosen from its byte order mark, per row, with
``decode``; the mark itself is kept apart so a rewrite can put it back.
U1: several corpora are searched as one by a union of (source, key, text).
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give a small input at least one partition per core.

    Single-file inputs scan as one task; big inputs already have one split per
    block and are returned unchanged (no shuffle).
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= want or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def read_table(spark: SparkSession, path: str, columns: Sequence[str],
               spread_small: bool = True) -> DataFrame:
    """Parquet table scan with only ``columns`` read."""
    df = spark.read.parquet(path).select(*columns)
    return spread(df) if spread_small else df


def read_files(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False,
               glob: str | None = None) -> DataFrame:
    """One row per file: ``path, modificationTime, length, content``.

    A directory argument is listed by Spark's file index: its files, plus
    partition-style subdirectories (``name=value``) as columns. Pass
    ``recursive=True`` to read every file below it whatever the directory
    names (then no partition columns); ``glob`` filters file names. With
    ``recursive`` and no ``glob``, directories of a mounted file system are
    listed and read by the tasks, and the driver keeps only ``paths``.
    """
    if isinstance(paths, str):
        paths = [paths]
    if recursive and not glob and (folders := _mounted(spark, paths)):
        return _read_below(spark, folders)
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(list(paths))


def _mounted(spark: SparkSession, paths: Sequence[str]) -> list[str] | None:
    """The outermost of ``paths``, if all are directories of a mounted file system and none is a pattern."""
    jsc = spark.sparkContext._jsc
    usual = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(jsc.hadoopConfiguration()).getScheme()
    found = set()
    for p in paths:
        scheme, path = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://[^/]*)?(.*)", p).groups()
        if (scheme or usual) != "file" or not path.startswith("/") or re.search(r"[][*?{}\\]", path) or not os.path.isdir(path):
            return None
        found.add("/" + os.path.normpath(path).lstrip("/"))

    def inside(p: str) -> bool:
        while p != "/":
            p = os.path.dirname(p)
            if p in found:
                return True
        return False

    return sorted(p for p in found if not inside(p))


BATCH_FILES, BATCH_BYTES = 1000, 4 << 20  # a batch of files ends with the one that reaches either


def _read_below(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Every file below mounted ``folders`` as Spark's reader gives it: no hidden and no empty files.

    The tasks list the folders, the names are dealt out evenly, and the tasks that
    get them read the files, a batch at a time.
    """
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2 ** 31 - 1)))
    n_files, n_bytes = BATCH_FILES, BATCH_BYTES

    def listed(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                               pa.array([r[1] for r in rows], pa.int64())], ["file", "ms"])
        for b in batches:
            rows, todo = [], b.column(0).to_pylist()
            while todo:
                with os.scandir(todo.pop()) as entries:
                    for e in entries:
                        hidden = ((e.name.startswith("_") and "=" not in e.name)
                                  or e.name.startswith(".") or e.name.endswith("._COPYING_"))
                        if e.is_dir():
                            if not hidden or e.name.startswith(("_metadata", "_common_metadata")):
                                todo.append(e.path)
                        elif not hidden and e.is_file() and (s := e.stat()).st_size:
                            rows.append((e.path, s.st_mtime_ns // 1_000_000))
                        if len(rows) == n_files:
                            yield out(rows)
                            rows = []
            yield out(rows)

    def read(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                ["path", "ms", "length", "content"])
        for b in batches:
            rows, size = [], 0
            for path, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if rows and (len(rows) >= n_files or size >= n_bytes):
                    yield out(rows)
                    rows, size = [], 0
                with open(path, "rb") as f:
                    length = os.fstat(f.fileno()).st_size
                    if length > most:
                        raise ValueError(f"{path} has {length} bytes, more than the {most} that a row can hold: see read_lines")
                    content = f.read()
                rows.append((f"file:{path}", ms, len(content), content))
                size += len(content)
            if rows:
                yield out(rows)

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = spark.createDataFrame([(p,) for p in folders], "folder string").mapInArrow(listed, "file string, ms bigint")
    files = names.repartition(n).mapInArrow(read, "path string, ms bigint, length bigint, content binary")
    return files.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "content")


# Byte order marks and the charset each selects. Longest marks are
# tested first.
BOMS = [
    ("0000FEFF", "UTF-32BE", 4),
    ("FFFE0000", "UTF-32LE", 4),
    ("EFBBBF", "UTF-8", 3),
    ("FFFE", "UTF-16LE", 2),
    ("FEFF", "UTF-16BE", 2),
    ("2B2F76", "UTF-7", 3),
]


def bom_columns(content: Column) -> tuple[Column, Column]:
    """(charset, bom length) chosen from the first bytes of ``content``."""
    head = F.hex(F.substring(content, 1, 4))
    charset = F.lit("UTF-8")
    nbom = F.lit(0)
    for mark, cs, n in reversed(BOMS):
        hit = head.startswith(mark)
        charset = F.when(hit, F.lit(cs)).otherwise(charset)
        nbom = F.when(hit, F.lit(n)).otherwise(nbom)
    return charset, nbom


RAW = "ISO-8859-1"  # one byte, one character: any bytes come back as they were


# the well-formed units of a charset, in bytes read one character each
UNITS = {"UTF-16BE": r"[^\xD8-\xDF].|[\xD8-\xDB].[\xDC-\xDF].",
         "UTF-16LE": r".[^\xD8-\xDF]|.[\xD8-\xDB].[\xDC-\xDF]",
         "UTF-32BE": r"\x00(?:\x00[^\xD8-\xDF]|[\x01-\x10].).",
         "UTF-32LE": r".(?:[^\xD8-\xDF]\x00|.[\x01-\x10])\x00"}


def _units_ok(body: Column, charset: str) -> Column:
    """Whether ``body`` is well-formed UTF-16 or UTF-32: one pass of a possessive loop, which keeps no stack."""
    return F.decode(body, RAW).rlike(rf"(?s)\A(?:{UNITS[charset]})*+\z")


def decode_bom(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``charset``, ``bom`` (bytes) and ``text`` decoded after the mark.

    Bytes that are not well-formed in the charset the mark selects (or in UTF-8
    without a mark) are read as ISO-8859-1, one character a byte, and
    ``charset`` says so; so are UTF-7 files, whose charset stays UTF-7 (Spark
    has no decoder for it; their ASCII text is searchable as it stands). Null
    content gives null text.
    """
    charset, nbom = bom_columns(F.col(content))
    body = F.expr(f"substring({content}, _nbom + 1)")
    marked = F.col("charset")
    ok = (F.when(marked == "UTF-8", F.is_valid_utf8(body.cast("string")))
           .when(marked == "UTF-16LE", _units_ok(body, "UTF-16LE"))
           .when(marked == "UTF-16BE", _units_ok(body, "UTF-16BE"))
           .when(marked == "UTF-32LE", _units_ok(body, "UTF-32LE"))
           .when(marked == "UTF-32BE", _units_ok(body, "UTF-32BE"))
           .otherwise(F.lit(True)))
    out = df.withColumn("charset", charset).withColumn("_nbom", nbom)
    out = out.withColumn("charset", F.when(ok, marked).otherwise(F.lit(RAW)))
    decoded = (F.when(marked == "UTF-8", F.decode(body, "UTF-8"))
                .when(marked == "UTF-16LE", F.decode(body, "UTF-16LE"))
                .when(marked == "UTF-16BE", F.decode(body, "UTF-16BE"))
                .when(marked == "UTF-32BE", F.decode(body, "UTF-32"))
                .when(marked == "UTF-32LE", F.decode(F.col(content), "UTF-32"))  # the mark tells the order
                .otherwise(F.decode(body, RAW)))
    return (out.withColumn("text", decoded)
               .withColumn("bom", F.expr(f"substring({content}, 1, _nbom)"))
               .drop("_nbom"))


def reencode(df: DataFrame, text: str = "text") -> DataFrame:
    """C14 on output: ``content`` = the file's own byte order mark + ``text``
    encoded in its detected charset (needs ``charset`` and ``bom`` from
    ``decode_bom``), so a rewritten file keeps its encoding and mark. Characters
    that ISO-8859-1 does not have (from a replacement) are written as ``?``."""
    t, cs = F.col(text), F.col("charset")
    latin = F.regexp_replace(t, r"[^\x00-\xFF]", "?")
    big = F.encode(t, "UTF-32")
    little = F.unhex(F.regexp_replace(F.hex(big), "(..)(..)(..)(..)", "$4$3$2$1"))
    enc = (F.when(cs == "UTF-8", F.encode(t, "UTF-8")).when(cs == "UTF-16LE", F.encode(t, "UTF-16LE"))
            .when(cs == "UTF-16BE", F.encode(t, "UTF-16BE")).when(cs == "UTF-32BE", big)
            .when(cs == "UTF-32LE", little).otherwise(F.encode(latin, RAW)))
    return df.withColumn("content", F.concat(F.col("bom"), enc))


def corpus_union(parts: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``(source, key, text)`` rows of several corpora, no dedup.

    ``parts`` holds (source name, frame, key column, text column); keys are
    cast to string so differently typed keys can share a column.
    """
    out = None
    for name, df, key, text in parts:
        one = df.select(F.lit(name).alias("source"), F.col(key).cast("string").alias("key"),
                        F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1, line route: ``file, line_no, text`` from a splittable text read.

    Big files are cut into blocks and read in parallel (no 2 GB one-row limit
    of ``binaryFile``); ``line_no`` is rebuilt from block offsets. Valid for
    dictionaries whose patterns contain no CR or LF (see ``line_safe``), since
    then no match can span a line and a walk is at the root at each line start.
    """
    from .dictionary_file import numbered_lines
    return numbered_lines(spark, path).select("file", "line_no", F.col("line").alias("text"))


def line_safe(patterns: Sequence[str]) -> bool:
    """True iff no pattern contains CR or LF (so line-by-line search is exact)."""
    return not any(("\n" in p) or ("\r" in p) for p in patterns)
