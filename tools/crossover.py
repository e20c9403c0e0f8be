"""Measure the regex scan against the anchor join by dictionary size.

Usage: python tools/crossover.py [sf_dir] [N ...]
Dictionaries are the N most frequent words of `documents` (a measurement
parameter, not a registered query). Prints one JSON line per N.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from multimatch.operators.anchor import find_all_anchor  # noqa: E402
from multimatch.operators.dictionary import compile_dictionary, dictionary_from_table  # noqa: E402
from multimatch.operators.search import find_all  # noqa: E402
from multimatch.session import local_session  # noqa: E402
from multimatch.sources.corpus import read_table  # noqa: E402


def timed(df) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - t, 2)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    sizes = [int(x) for x in argv[2:]] or [10, 100, 1000, 4000]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    docs = read_table(spark, f"{sf_dir}/documents.parquet", ["doc_id", "text"]).cache()
    docs.count()
    words = (docs.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w"))
             .where(F.length("w") >= 3).groupBy("w").count()
             .orderBy(F.desc("count"), "w").cache())
    for n in sizes:
        top = words.limit(n).withColumn("rank", F.monotonically_increasing_id())
        d = dictionary_from_table(top, "w", F.upper("w"), order_col="rank").cache()
        d.count()
        t = time.time()
        cd = compile_dictionary(d, max_patterns=10**6, max_chars=1 << 28)
        t_compile = round(time.time() - t, 2)
        res = {"n_words": n, "active": len(cd.entries), "regex_chars": len(cd.retry_regex or ""),
               "compile_sec": t_compile,
               "regex_sec": timed(find_all(docs, cd)),
               "anchor_sec": timed(find_all_anchor(docs, d, "doc_id", "text"))}
        print(json.dumps(res), flush=True)
        d.unpersist()


if __name__ == "__main__":
    main(sys.argv)
