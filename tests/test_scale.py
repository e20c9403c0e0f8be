"""Results that must not depend on the size of the input or on its keys."""

import re

import pytest
from pyspark.sql import functions as F

import brute
from multimatch.functions.regex import retry_regex, walk_regex
from multimatch.operators import search
from multimatch.operators.anchor import find_all_anchor
from multimatch.operators.dictionary import (assign_replacement_ids, compile_dictionary, consecutive_index,
                                             dictionary_from_pairs, shadowed_patterns)
from multimatch.sources import corpus
from multimatch.sources import dictionary_file as dict_file
from multimatch.session import shared_dir


@pytest.mark.parametrize("parts,coalesce", [(8, "true"), (16, "false")])
def test_consecutive_index_numbers_every_row_once(spark, parts, coalesce):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        n = 400_000
        wide = spark.range(0, n, 1, 7).select(F.col("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("w"))
        got = consecutive_index(wide, ["w"], "i").agg(
            F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
        assert tuple(got) == (n, n, 0, n - 1)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_replacement_ids_of_many_distinct_replacements(spark):
    n = 100_000
    lines = spark.range(0, n, 1, 5).select(
        F.col("id").alias("line_no"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("pattern"),
        F.repeat(F.sha2((F.col("id") % (n // 2)).cast("string"), 256), 2).alias("replacement"))
    wrong = assign_replacement_ids(lines).where(F.col("replacement_id") != F.col("line_no") % (n // 2)).count()
    assert wrong == 0


def test_null_and_repeated_keys_match_row_by_row(spark):
    rows = [(1, "x", "abc de"), (1, "x", "cde abc"), (None, "x", "abc"), (None, None, "abcabc"), (2, "y", None)]
    df = spark.createDataFrame(rows, "a INT, b STRING, text STRING")
    d = dictionary_from_pairs(spark, [("abc", "1"), ("cde", "2"), ("c d", "3")])
    for keys in (["a", "b"], "a"):
        want = search.find_all(df, compile_dictionary(d), keys)
        for kw in ({}, {"broadcast_rows": 0}):
            got = find_all_anchor(df, d, keys, **kw)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_contains_pairs_with_nul_and_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "a\0b hello"), (1, "hello"), (None, "a\0b")], "d INT, t STRING")
    pats = spark.createDataFrame([(7, "a\0b"), (8, "hello"), (9, "")], "k INT, p STRING")
    got = sorted(map(tuple, search.contains_pairs(docs, pats, "d", "t", "k", "p").fillna(-1).collect()))
    assert got == [(-1, 7), (1, 7), (1, 8), (1, 8)]


def test_nested_branch_points_do_not_recurse():
    pats = ["a" * i + "b" for i in range(1300)]
    rx = re.compile(walk := retry_regex(pats[:60]))
    assert walk_regex(pats[:5]) and rx.search("xxaaab").group() == "aaab"
    assert len(retry_regex(pats)) > 1300


def test_shadowed_patterns_by_occurring_lengths(spark):
    words = ["a", "ab", "abc", "b" * 3000, "b" * 2999, "xyz", "xy"]
    got = {r.pattern: r.shadowed_by for r in shadowed_patterns(
        spark.createDataFrame([(w,) for w in words], "pattern STRING")).collect()}
    assert got == {"ab": "a", "abc": "a", "b" * 3000: "b" * 2999, "xyz": "xy"}


def test_thousands_of_regex_lines(spark):
    rows = [(i, f"k{i}[a-c]+;", "r") for i in range(5000)]
    df = spark.createDataFrame([(1, "zz k4999abc; k12a; k12d; k77cc;")], "doc_id INT, text STRING")
    got = [(r.start, r.text, r.line_no) for r in search.find_all_regex(df, rows, "doc_id").orderBy("start").collect()]
    assert got == [(3, "k4999abc;", 4999), (13, "k12a;", 12), (25, "k77cc;", 77)]


def test_any_bytes_decode_and_come_back(spark):
    text = "h\u00e9llo \U0001f600"
    files = {
        0: (b"caf\xe9", "ISO-8859-1", "caf\u00e9"),
        1: (b"\xff\xfe" + text.encode("utf-16-le"), "UTF-16LE", text),
        2: (b"\xff\xfea\x00\x00\xd8", "ISO-8859-1", None),
        3: (b"\xff\xfe\x00\x00" + text.encode("utf-32-le"), "UTF-32LE", text),
        4: (b"+/v8-abc", "UTF-7", None),
        5: (b"\xfe\xff\xd8", "ISO-8859-1", None),
        6: (b"\xef\xbb\xbf" + text.encode(), "UTF-8", text),
        7: (b"", "UTF-8", ""),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in files.items()], "id INT, content BINARY")
    dec = corpus.decode_bom(df)
    back = {r.id: r for r in corpus.reencode(dec).collect()}
    for k, (raw, charset, want) in files.items():
        assert back[k].charset == charset and bytes(back[k].content) == raw, k
        assert want is None or back[k].text == want


def test_utf16_pattern_file(spark, tmp_path):
    root = shared_dir(spark, "utf16")
    import os
    os.makedirs(root)
    with open(f"{root}/p.txt", "wb") as f:
        f.write(b"\xff\xfe" + 'x "\u00e9t\u00e9" => "summer"\r\n"two" "2"\r\n'.encode("utf-16-le"))
    got = [(r.line_no, r.pattern, r.replacement) for r in dict_file.load_dictionary(
        spark, f"{root}/p.txt", decode=True).orderBy("line_no").collect()]
    assert got == [(0, "\u00e9t\u00e9", "summer"), (1, "two", "2")]


def test_writer_rule():
    assert brute.writer("a  \nb a b", [(0, "a"), (4, "b"), (6, "a")], {"a": "1", "b": "2"}) == "1  \n2 1 b"
    assert brute.writer("axa", [(0, "a"), (2, "a")], {"a": "1"}) == "1\nx1"


def test_large_dictionary_route_equals_the_compiled_one(spark):
    from multimatch.operators import large, report, rewrite
    rows = [(1, "abc x  \nabcde cde"), (1, "cde"), (None, "abcabc  ab"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id INT, text STRING")
    d = dictionary_from_pairs(spark, [("abc", "1"), ("cde", "22"), ("ab", "3"), ("x", ""), ("cde", "9")])
    cd = compile_dictionary(d)
    kw = {"broadcast_rows": 0}
    same = lambda a, b: sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    for emit in ("replace", "insert_before"):
        for brk in (False, True):
            assert same(large.replace_all_large(df, d, emit=emit, line_break=brk, **kw),
                        rewrite.replace_all(df, cd, emit=emit, line_break=brk)), (emit, brk)
    assert same(large.doc_match_counts_large(df, d, **kw), report.doc_match_counts(df, cd))
    assert same(large.match_report_large(df, d, **kw), report.match_report(df, cd))
    assert same(large.pattern_hit_counts_large(df, d, **kw), report.pattern_hit_counts(df, cd, d))
    assert same(large.docs_matching_large(df, d, **kw), search.docs_matching(df, cd))
    assert same(large.docs_matching_large(df, d, negate=True, **kw), search.docs_not_matching(df, cd))


def test_raw_files_are_matched_and_rewritten_as_they_land(spark):
    import os
    from multimatch.streaming import incremental
    root = shared_dir(spark, "files")
    os.makedirs(f"{root}/in/sub")
    cd = compile_dictionary(dictionary_from_pairs(spark, [("\u00e9t\u00e9", "summer")]))

    def put(name, raw):
        with open(f"{root}/in/{name}", "wb") as f:
            f.write(raw)

    put("a.txt", "un \u00e9t\u00e9".encode())
    put("sub/b.txt", b"\xff\xfe" + "\u00e9t\u00e9!".encode("utf-16-le"))
    for batch in (1, 2):
        incremental.run_once(incremental.match_file_stream(spark, f"{root}/in", cd), f"{root}/m", f"{root}/cm")
        incremental.run_once(incremental.rewrite_file_stream(spark, f"{root}/in", cd), f"{root}/r", f"{root}/cr")
        put("c.txt", b"\xe9t\xe9 raw bytes")
        put("d.txt", b"nothing")
    got = {os.path.basename(r.path): bytes(r.content) for r in spark.read.parquet(f"{root}/r").collect()}
    assert got == {"a.txt": b"un summer", "b.txt": b"\xff\xfe" + "summer!".encode("utf-16-le"), "c.txt": b"summer raw bytes"}
    assert spark.read.parquet(f"{root}/m").count() == 3
