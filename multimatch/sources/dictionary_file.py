"""Pattern files: load, reject, save.

Format (one pair per line): text before the first mark is ignored, the
pattern sits between marks 1 and 2, at least one separator character follows,
the replacement sits between the next two marks (its first character may be
the mark itself), the rest is ignored. Reading a file stops at its first empty
line; a leading byte order mark is dropped.

The read is splittable: ``spark.read.text`` cuts big files into blocks. The
lines are written once with the block they came from and their place in it, and
numbered from what was written: a second read may cut the files elsewhere (the
size of a split depends on the cores registered at that moment). The tables of
blocks and of stops have one row per block and file; they are joined without a
broadcast hint, so adaptive execution broadcasts them only when their measured
size is under the threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import assign_replacement_ids, materialize, running_total
from ..session import written

DEFAULT_GROUPING = '"'


def _rx(g: str) -> dict[str, str]:
    m = re.escape(g) if g not in "\\" else "\\\\"
    n = f"[^{m}]"
    return {
        "pair": f"(?s)^{n}*{m}({n}*){m}.{n}*{m}(.{n}*){m}",
        "no_sep": f"(?s)^{n}*{m}{n}*{m}{m}",
        "empty_repl": f"(?s)^{n}*{m}{n}*{m}.{n}*{m}{m}{n}*\\z",
    }


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file STRING, line_no BIGINT, line STRING``: lines in file order, per path.

    ``line_no`` counts across the files of ``path`` in path order (a single
    pattern file numbers from 0).
    """
    raw = written(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value").alias("line")), "lines")
    # a block was read by one task, in order
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = running_total(blocks, ["file", "block"], F.col("_n"), "_off").drop("_n")
    at = F.col("_mid") - F.col("_first")
    # a leading byte order mark belongs to the file, not the first pattern
    line = F.when((F.col("block") == 0) & (at == 0), F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return raw.join(offsets, ["file", "block"]).select(
        "file", (F.col("_off") + at).alias("line_no"), line.alias("line"))


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """``numbered_lines`` of files in any encoding with a byte order mark (each file read whole)."""
    from .corpus import decode_bom, read_files
    parts = F.split("text", r"\r\n|\r|\n")
    # what follows the last line break is a line only if there is something
    lines = F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    files = decode_bom(read_files(spark, path)).select(F.col("path").alias("file"), lines.alias("_lines"))
    # numbered files: one row per file, with its lines
    files = running_total(files, ["file"], F.size("_lines"), "_off")
    return files.select("file", "_off", F.posexplode("_lines").alias("_at", "line")).select(
        "file", (F.col("_off") + F.col("_at")).cast("long").alias("line_no"), "line")


def _until_first_empty(lines: DataFrame) -> DataFrame:
    """C11: drop each file's lines from its first empty line on."""
    stops = lines.where(F.col("line") == "").groupBy("file").agg(F.min("line_no").alias("_stop"))
    return (lines.join(stops, "file", "left")
                 .where(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))
                 .drop("_stop"))


def parse_lines(lines: DataFrame, grouping: str = DEFAULT_GROUPING) -> DataFrame:
    """Add ``pattern``, ``replacement`` and ``reason`` (null when the line is good)."""
    if len(grouping) != 1:
        raise ValueError("grouping must be one character")
    rx = _rx(grouping)
    line = F.col("line")
    pat = F.regexp_extract(line, rx["pair"], 1)
    rep = F.regexp_extract(line, rx["pair"], 2)
    ok = line.rlike(rx["pair"])
    reason = (F.when(F.instr(line, grouping) == 0, F.lit("no marks"))
               .when(~ok & line.rlike(rx["no_sep"]), F.lit("no separator"))
               .when(~ok & line.rlike(rx["empty_repl"]), F.lit("empty replacement"))
               .when(~ok, F.lit("no replacement"))
               .when(F.length(pat) == 0, F.lit("empty pattern"))
               .when(F.instr(pat, "\u0000") > 0, F.lit("NUL in pattern")))
    return lines.select("*", F.when(ok, pat).alias("pattern"), F.when(ok, rep).alias("replacement"),
                        reason.alias("reason"))


def load_dictionary(spark: SparkSession, path: str, grouping: str = DEFAULT_GROUPING,
                    decode: bool = False) -> DataFrame:
    """The dictionary ``line_no, pattern, replacement, replacement_id`` of a pattern file.

    ``decode=True`` reads the file whole and decodes it by its byte order mark
    (UTF-16, UTF-32); otherwise it is read as UTF-8, in blocks.
    """
    lines = decoded_lines(spark, path) if decode else numbered_lines(spark, path)
    parsed = parse_lines(_until_first_empty(lines), grouping)
    good = parsed.where(F.col("reason").isNull()).select("line_no", "pattern", "replacement")
    return materialize(assign_replacement_ids(good))


def dictionary_rejects_file(spark: SparkSession, path: str, grouping: str = DEFAULT_GROUPING,
                            decode: bool = False) -> DataFrame:
    """``line_no, line, reason`` for every line the loader refuses (``decode`` as in ``load_dictionary``)."""
    lines = decoded_lines(spark, path) if decode else numbered_lines(spark, path)
    parsed = parse_lines(_until_first_empty(lines), grouping)
    return parsed.where(F.col("reason").isNotNull()).select(F.col("line_no").cast("int").alias("line_no"), "line",
                                                            "reason")


def save_dictionary(df: DataFrame, path: str) -> str:
    """Keep a dictionary as a parquet table (the saved form of the trie)."""
    df.select("line_no", "pattern", "replacement", "replacement_id").write.mode(
        "overwrite").parquet(path)
    return path


def read_saved_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("line_no", "pattern", "replacement", "replacement_id")
