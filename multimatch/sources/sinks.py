"""Sinks: versioned rewrite output (S7), the match log (S8), one file per row.

The reference rewrites files in place and may keep ``.bak`` copies. Here a
rewrite never touches what is being read. A run reserves the next version number
by creating a file that no other run can create again, writes the files of the
version, and commits it with a manifest that names them; a version without a
manifest (its job failed, or still runs) is never read. The version before is the
backup: ``restore`` commits a new version that names an old one's files.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import keep_where


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _create(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file, unless there is one."""
    fs, p = _files(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions under ``root``."""
    return sorted(int(n[2:-5]) for n in _names(spark, f"{root.rstrip('/')}/_manifests")
                  if n.startswith("v=") and n.endswith(".json"))


def reserve_version(spark: SparkSession, root: str) -> int:
    """the next version number; of several runs at once each gets its own (where creating a file is atomic, as on HDFS)."""
    root = root.rstrip("/")
    taken = [int(n[2:]) for d in (root, f"{root}/_reserved") for n in _names(spark, d) if n.startswith("v=")]
    v = max([0, *taken, *versions(spark, root)]) + 1
    while not _create(spark, f"{root}/_reserved/v={v}"):
        v += 1
    return v


def _commit(spark: SparkSession, root: str, version: int, manifest: dict) -> None:
    fs, whole = _files(spark, f"{root}/_manifests/v={version}.json")
    if not _create(spark, f"{root}/_manifests/_v={version}.part", json.dumps(manifest)):
        raise RuntimeError(f"version {version} was written before")
    if not fs.rename(_files(spark, f"{root}/_manifests/_v={version}.part")[1], whole):  # all of it or nothing
        raise RuntimeError(f"version {version} was not committed")


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    """Format, schema and files of a committed version."""
    lines = spark.read.text(f"{root.rstrip('/')}/_manifests/v={version}.json", wholetext=True).collect()
    return json.loads(lines[0]["value"])


def write_rewrites(rewritten: DataFrame, root: str, only_changed: bool = True,
                   fmt: str = "parquet") -> str:
    """Write the rewritten documents (by default only changed ones) as a new version; its path."""
    spark, root = rewritten.sparkSession, root.rstrip("/")
    version = reserve_version(spark, root)
    path = f"{root}/v={version}"
    out = (keep_where(rewritten, F.col("n_matches") > 0, *[F.col(c) for c in rewritten.columns])
           if only_changed else rewritten)
    out.write.mode("errorifexists").format(fmt).save(path)
    files = [f"v={version}/{n}" for n in _names(spark, path) if not n.startswith(("_", "."))]
    _commit(spark, root, version, {"format": fmt, "schema": out.schema.json(), "files": files})
    return path


def restore(spark: SparkSession, root: str, version: int) -> int:
    """Commit a new version that is an earlier one again (no file is copied); its number."""
    old, new = manifest(spark, root, version), reserve_version(spark, root)
    _commit(spark, root.rstrip("/"), new, {**old, "restored": version})
    return new


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a committed version (the last one, if none is named): the files its manifest names."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no committed version {version or ''} under {root}")
    m = manifest(spark, root, known[-1] if version is None else version)
    from pyspark.sql.types import StructType
    schema = StructType.fromJson(json.loads(m["schema"]))
    if not m["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.format(m["format"]).schema(schema).load([f"{root.rstrip('/')}/{f}" for f in m["files"]])


def log_text(line: Column) -> Column:
    """A log line as it is written: line breaks and backslashes inside it are escaped, so that a match is one line."""
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        line = F.replace(line, F.lit(plain), F.lit(escaped))
    return line


def write_log(lines: DataFrame, path: str) -> str:
    """The match log as text, one line per row of ``lines(line)`` (written only if there are any).

    The search runs once: lines are counted as they are written, and a log
    without lines is taken back.
    """
    spark = lines.sparkSession
    seen = Observation("log")
    out = lines.select(log_text(F.col("line")).alias("value"))
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").text(path)
    if seen.get["n"]:
        return path
    fs, p = _files(spark, path)
    fs.delete(p, True)
    return ""


PER_FOLDER = 1000  # files in one folder


def write_files(df: DataFrame, path: str, key: str, text: str = "text") -> list[str]:
    """Every row's text and a line feed as one file (null text: the line feed); the folders that hold the files.

    A file's name, or in Spark's own layout its folder's, begins with ``<key>=``
    and the key: ``file_key`` reads it. On a mounted file system the tasks write
    the files, into folders of their own, and only those of tasks that ended well
    are returned. Spark's writer, used elsewhere, starts two processes per file
    there (``chmod``) and makes a folder per key, each listed by a task.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fs, p = _files(spark, path)
    fs.mkdirs(p)
    if fs.getUri().getScheme() != "file":
        df.select(key, text).write.mode("append").partitionBy(key).text(path)
        return [path]
    root = p.toUri().getPath()

    def run(batches):
        n, folder = 0, ""
        for b in batches:
            made = []
            for k, t in zip(b.column(0), b.column(1)):
                if n % PER_FOLDER == 0:
                    folder = uuid.uuid4().hex
                    os.mkdir(f"{root}/{folder}")
                    made.append(folder)
                with open(f"{root}/{folder}/{key}={k.as_py()}.{n}.txt", "xb") as f:
                    f.write((t.as_py() or b"") + b"\n")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["folder"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("binary").alias("t"))
    return [f"{path}/{r['folder']}" for r in rows.mapInArrow(run, "folder string").collect()] or [path]


def file_key(path: Column, key: str) -> Column:
    """The key (a whole number, or null) of a file that ``write_files`` has written."""
    return F.nullif(F.regexp_extract(path, rf"/{key}=(-?[0-9]*)[^/]*(?:/[^/]*)?\z", 1), F.lit("")).cast("bigint")
