"""Files, BOMs, sinks, streaming and the driver contract."""

import os


from paths import SF001
from multimatch.operators import rewrite, search
from multimatch.operators.dictionary import compile_dictionary, dictionary_from_pairs
from multimatch.plans import fixtures
from multimatch.session import shared_dir
from multimatch.sources import corpus, sinks
from multimatch.sources import dictionary_file as dict_file


def test_manual_fixture_end_to_end(spark):
    assert len(fixtures.SAMPLE_SEARCH_TEXT.encode()) == 116
    root = shared_dir(spark, "fixture")
    os.makedirs(f"{root}/TestData/Search")
    with open(f"{root}/TestData/Patterns.txt", "w", encoding="utf-8") as f:
        f.write(fixtures.SAMPLE_PATTERN_FILE)
    with open(f"{root}/TestData/Search/test.txt", "w", encoding="utf-8") as f:
        f.write(fixtures.SAMPLE_SEARCH_TEXT)
    d = dict_file.load_dictionary(spark, f"{root}/TestData/Patterns.txt")
    cd = compile_dictionary(d)
    files = corpus.decode_bom(corpus.read_files(spark, f"{root}/TestData/Search"))
    for mode in ("retry", "walk"):
        ms = search.find_all(files, cd, "path", "text", mode).collect()
        assert [(m.ordinal, m.start, m.end, m.length, m.text, m.replacement_id) for m in ms] == \
            [(0, 78, 86, 8, "test one", 0)]
    out = rewrite.replace_all(files, cd, "path", "text").first()
    assert out.n_matches == 1
    assert out.text == fixtures.SAMPLE_SEARCH_TEXT.replace("replace onetest one", "replace onereplace one")
    from multimatch.operators.report import match_report
    rep = match_report(files, cd, "path", "text").first()
    assert rep.report == f"{rep.path}:  replace one <- 'test one'"


def test_bom_detection(spark):
    text = "héllo\nwörld"
    rows = [
        (0, b"\xef\xbb\xbf" + text.encode("utf-8"), "UTF-8"),
        (1, b"\xff\xfe" + text.encode("utf-16-le"), "UTF-16LE"),
        (2, b"\xfe\xff" + text.encode("utf-16-be"), "UTF-16BE"),
        (3, b"\x00\x00\xfe\xff" + text.encode("utf-32-be"), "UTF-32BE"),
        (4, text.encode("utf-8"), "UTF-8"),
    ]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b, _ in rows], "id INT, content BINARY")
    got = {r.id: (r.charset, r.text, len(r.bom)) for r in corpus.decode_bom(df).collect()}
    for i, b, cs in rows:
        assert got[i][0] == cs and got[i][1] == text
    assert [got[i][2] for i in range(5)] == [3, 2, 2, 4, 0]


def test_versioned_rewrite_sink(spark):
    cd = compile_dictionary(dictionary_from_pairs(spark, [("a", "b")]))
    df = spark.createDataFrame([(1, "xa"), (2, "zz")], "doc_id BIGINT, text STRING")
    root = shared_dir(spark, "versions")
    p1 = sinks.write_rewrites(rewrite.replace_all(df, cd), root)
    p2 = sinks.write_rewrites(rewrite.replace_all(df, cd), root)
    assert p1.endswith("v=1") and p2.endswith("v=2")
    rows = sinks.read_version(spark, root).collect()
    assert [(r.doc_id, r.text) for r in rows] == [(1, "xb")]


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["doc_id", "ordinal", "start", "end", "length", "text", "replacement_id"]
    assert df.count() > 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 35


def test_incremental_scan_equals_batch(spark):
    import __spark_entry__ as e
    a = e.queries()["incremental_scan"](spark, SF001)
    b = e.queries()["find_all"](spark, SF001)
    cols = b.columns
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.collect()))


def test_line_numbers_across_splits(spark):
    root = shared_dir(spark, "lines")
    os.makedirs(root)
    lines = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    with open(f"{root}/big.txt", "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(root).rdd.getNumPartitions() > 10
        df = corpus.read_lines(spark, root)
        got = sorted((r.line_no, r.text) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(lines))


def test_line_safe():
    assert corpus.line_safe(["a", "b c"]) and not corpus.line_safe(["a\nb"])
    assert not corpus.line_safe(["x\r"])


def test_reencode_round_trip_keeps_bom(spark):
    text = "a test one\nb"
    raw = [b"\xef\xbb\xbf" + text.encode("utf-8"), b"\xff\xfe" + text.encode("utf-16-le"),
           b"\xfe\xff" + text.encode("utf-16-be"), text.encode("utf-8")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "id INT, content BINARY")
    dec = corpus.decode_bom(df)
    cd = compile_dictionary(dictionary_from_pairs(spark, [("test one", "X"), ("zz", "Y")]))
    out = rewrite.replace_all(dec, cd, "id", "text").join(dec.select("id", "charset", "bom"), "id")
    got = {r.id: bytes(r.content) for r in corpus.reencode(out).collect()}
    for i, b in enumerate(raw):
        want_text = text.replace("test one", "X")
        enc = {0: "utf-8", 1: "utf-16-le", 2: "utf-16-be", 3: "utf-8"}[i]
        bom = b[:{0: 3, 1: 2, 2: 2, 3: 0}[i]]
        assert got[i] == bom + want_text.encode(enc)
    same = {r.id: bytes(r.content) for r in corpus.reencode(dec).collect()}
    assert [same[i] for i in range(4)] == raw


def test_uncommitted_version_is_skipped(spark):
    cd = compile_dictionary(dictionary_from_pairs(spark, [("a", "b")]))
    df = spark.createDataFrame([(1, "xa")], "doc_id BIGINT, text STRING")
    root = shared_dir(spark, "versions2")
    sinks.write_rewrites(rewrite.replace_all(df, cd), root)
    os.makedirs(f"{root}/v=2")  # left behind by a job that never committed
    assert sinks.reserve_version(spark, root) == 3
    assert [(r.doc_id, r.text) for r in sinks.read_version(spark, root).collect()] == [(1, "xb")]


def test_versions_of_writers_at_once_and_restore(spark):
    from concurrent.futures import ThreadPoolExecutor
    cd = compile_dictionary(dictionary_from_pairs(spark, [("a", "b")]))
    frames = [spark.createDataFrame([(i, f"{i}a"), (9, "z")], "doc_id BIGINT, text STRING") for i in range(4)]
    root = shared_dir(spark, "versions3")
    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(lambda df: sinks.write_rewrites(rewrite.replace_all(df, cd), root), frames))
    assert sorted(p.rsplit("=", 1)[1] for p in paths) == ["1", "2", "3", "4"] and sinks.versions(spark, root) == [1, 2, 3, 4]
    assert {r.text for v in range(1, 5) for r in sinks.read_version(spark, root, v).collect()} == {f"{i}b" for i in range(4)}
    second = sinks.read_version(spark, root, 2).collect()
    assert sinks.restore(spark, root, 2) == 5
    assert sinks.read_version(spark, root).collect() == second
    assert sinks.manifest(spark, root, 5)["restored"] == 2
    path = sinks.write_rewrites(rewrite.replace_all(frames[0].where("doc_id = 9"), cd), root)
    assert path.endswith("v=6") and sinks.read_version(spark, root).count() == 0


def test_arrivals_with_a_growing_dictionary(spark):
    from multimatch.operators.search import find_all
    from multimatch.streaming import incremental
    root, schema = shared_dir(spark, "arrivals"), "doc_id BIGINT, text STRING"
    pairs = [("abc", "1"), ("cd", "2"), ("bc", "3"), ("ab", "4"), ("abc", "5")]
    d = dictionary_from_pairs(spark, pairs)
    texts = ["abcd bc", "xab", "cdcd abc", "", None, "bcabc"]
    frames = [spark.createDataFrame([(i, t)], schema) for i, t in enumerate(texts)]

    def put(*which):
        for i in which:
            frames[i].write.mode("append").parquet(f"{root}/in")

    def run(lines):
        incremental.scan_arrivals(spark, f"{root}/in", schema, d.where(lines), f"{root}/out", "doc_id")
        got = incremental.arrived_matches(spark, f"{root}/out", "doc_id")
        seen = spark.read.schema(schema).parquet(f"{root}/in")
        known = [p for i, p in enumerate(pairs) if spark.read.parquet(f"{root}/out/lines").where(f"line_no = {i}").count()]
        want = find_all(seen, compile_dictionary(dictionary_from_pairs(spark, known)))
        cols = ["doc_id", "ordinal", "start", "end", "length", "text"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
        return got.count()

    put(0, 1)
    run("line_no < 2")
    put(2, 3, 4)
    run("line_no < 3")  # a new line and new files
    n = run("line_no < 3")  # nothing new
    assert run("line_no < 3") == n
    run("line_no >= 0")  # new lines only
    put(5)
    n = run("line_no >= 0")
    # a batch whose commit was lost runs again under its number
    import shutil
    last = max(int(f) for f in os.listdir(f"{root}/out/checkpoint/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{root}/out/checkpoint/commits/{f}"):
            os.remove(f"{root}/out/checkpoint/commits/{f}")
    assert run("line_no >= 0") == n
    shutil.rmtree(f"{root}/out/occurrences/set=2")  # nor does a set whose search was not finished get lost
    assert run("line_no >= 0") == n
