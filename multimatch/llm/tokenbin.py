"""Token ids of a document table as Simple-8b files, and their vectorised reading.

Documents are ordered by id (ties: as they are read) and cut into ranges; a task
encodes the texts of its range and writes *segments* of whole documents: one
row of a Parquet file with ``part`` (the range), ``first`` (ids of the range before
it), ``ids`` (the documents' ids), ``counts`` (tokens of each) and ``words``
(``simple8b.pack`` of all tokens, end ids included). A second, small table
``parts`` has the tokens before each range, one row per written file. Positions
in the corpus are thus known without opening ``words``, and a range of positions
is read from the segments and blocks that hold it.

Parquet is the container because tasks write it through Spark's committer to any
store and a reader fetches only the columns it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import CLEANUP
from .repeats import runs
from .simple8b import Packed, pack
from .wordids import ByteBpe, Words, remembered, utf8

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"
END = 2
SEGMENT_OPTIONS = {  # words are packed already; rows are large: look at page and row group sizes after each
    "compression": "snappy", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` in ranges by ascending id, null first; any number of rows may have one id."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                      F.monotonically_increasing_id().alias("n"))
    return src.repartitionByRange("id", "n").sortWithinPartitions("id", "n").select("id", "text")


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END,
              file: str = DEFAULT_FILE) -> str:
    """Encode every whole text, append ``end`` to each, and write the files below ``path``.

    Null and empty texts have the end id alone; bytes that are no UTF-8 are read
    as U+FFFD; rows with a repeated or null id are documents of their own, those of
    one id in the order they are read; other columns are ignored; an empty table
    gives files without segments.
    """
    spark = docs.sparkSession
    with open(file, encoding="utf-8") as f:  # a vocabulary, of bounded size
        state = spark.sparkContext.broadcast({"file": f.read()})
    src = ordered(docs, id_col, text_col)
    stop = np.array([end], np.int64)

    def run(batches):
        state_ = state.value
        words = remembered(state_, "words", lambda: Words([ByteBpe(state_["file"], plain=False)], lead=False))
        part, first = TaskContext.get().partitionId(), 0
        for b in batches:
            for at, texts in runs(b.column(1).to_pylist()):
                ((ids, counts),), _ = words.encode([utf8(t) for t in texts])
                flat = np.insert(ids.astype(np.int64), np.cumsum(counts), stop)
                offsets = pa.array([0, len(texts)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(flat)], pa.int64()),
                     pa.ListArray.from_arrays(offsets, b.column(0).slice(at, len(texts))),
                     pa.ListArray.from_arrays(offsets, pa.array(counts + 1)), pa.array([pack(flat)], pa.binary())],
                    ["part", "first", "n", "ids", "counts", "words"])
                first += len(flat)

    kind = src.schema["id"].dataType.simpleString()
    segments = src.mapInArrow(run, f"part int, first bigint, n bigint, ids array<{kind}>, counts array<bigint>, "
                                   "words binary")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        segments.write.options(**SEGMENT_OPTIONS).parquet(f"{path}/segments")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    # one row per range written, in the order of the ranges
    sizes = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in sizes], dtype=np.int64)])
    rows = [(r["part"], int(s)) for r, s in zip(sizes, starts)]
    spark.createDataFrame(rows, "part int, start bigint").coalesce(1).write.parquet(f"{path}/parts")
    return path


def segments_of(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The segments with ``start``, the tokens of all documents before each; of ``columns``, only those are read."""
    parts = spark.read.parquet(f"{path}/parts")  # one row per written range
    got = spark.read.parquet(f"{path}/segments").select("part", "first", *columns)
    return got.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("first"))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens`` of every document, without reading any token."""
    segments = segments_of(spark, path, ["ids", "counts"])
    each = segments.select("start", F.posexplode(F.arrays_zip("ids", "counts")).alias("at", "d"), "counts")
    before = F.aggregate(F.slice("counts", F.lit(1), F.col("at")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return each.select(F.col("d.ids").alias("id"), (F.col("start") + before).alias("start"),
                       F.col("d.counts").alias("n_tokens"))


def read_documents(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document and, with ``tokens``, its ``tokens``, decoded."""
    src = segments_of(spark, path, ["ids", "counts", "words"]).select("start", "ids", "counts", "words")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                counts = b.column(2)[k].values.to_numpy()
                flat = Packed(b.column(3)[k].as_py()).decode().astype("<u4")
                ends = np.cumsum(counts)
                cuts, raw = (ends * 4).tolist(), memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[a:z]) for a, z in zip([0, *cuts], cuts)]
                rows = [b.column(1)[k].values, pa.array(b.column(0)[k].as_py() + ends - counts), pa.array(counts),
                        pa.array(crc, pa.int64())]
                if tokens:
                    rows.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                                         pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(rows, names)

    names = ["id", "start", "n_tokens", "ids_crc32", *(["tokens"] if tokens else [])]
    kind = src.schema["ids"].dataType.elementType.simpleString()
    return src.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
                               + (", tokens array<int>" if tokens else ""))


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``start, tokens``: the tokens at positions ``first`` to ``last - 1`` of the corpus, in runs by segment.

    Only segments that hold some of them are opened, and only their blocks there are decoded.
    """
    src = segments_of(spark, path, ["n", "words"])
    src = src.where((F.col("start") < last) & (F.col("start") + F.col("n") > first)).select("start", "words")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                start = b.column(0)[k].as_py()
                a = max(first - start, 0)
                got = Packed(b.column(1)[k].as_py()).decode(a, last - start).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start + a]), pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), pa.array(got))],
                    ["start", "tokens"])

    return src.mapInArrow(run, "start bigint, tokens array<bigint>")


def op11(spark, sf_dir: str, file: str = DEFAULT_FILE) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_ids(docs, shared_dir(spark, "token-ids"), file=file)
    return read_documents(spark, path, tokens=False).withColumnRenamed("id", "doc_id")
