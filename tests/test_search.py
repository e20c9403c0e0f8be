"""Matching, rewriting and reports on small inputs, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from brute import first_lines, replace, retry, walk
from multimatch.operators import anchor, report, rewrite, search
from multimatch.operators.dictionary import compile_dictionary, dictionary_from_pairs


def texts_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")


def matches(spark, pairs, texts, mode="retry", alias=None):
    cd = compile_dictionary(dictionary_from_pairs(spark, pairs), alias=alias)
    rows = search.find_all(texts_df(spark, texts), cd, "doc_id", "text", mode).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.ordinal)):
        out.setdefault(r.doc_id, []).append((r.start, r.text))
    return out, rows


# FIXTURES.md section 4: (patterns, text, retry starts, walk starts)
CASES = [
    (["abc"], "aabc", [(1, "abc")], []),
    (["ab", "abc"], "abc", [(0, "ab")], [(0, "ab")]),
    (["a"], "ba", [(1, "a")], [(1, "a")]),
    (["ab"], "abab", [(0, "ab"), (2, "ab")], [(0, "ab"), (2, "ab")]),
    ([".", "*", "("], "a.b*(", [(1, "."), (3, "*"), (4, "(")], [(1, "."), (3, "*"), (4, "(")]),
]


@pytest.mark.parametrize("pats,text,want_retry,want_walk", CASES)
def test_small_cases(spark, pats, text, want_retry, want_walk):
    pairs = [(p, p.upper() or "X") for p in pats]
    got, _ = matches(spark, pairs, [text], "retry")
    assert got.get(0, []) == want_retry
    got, _ = matches(spark, pairs, [text], "walk")
    assert got.get(0, []) == want_walk


def test_alias(spark):
    got, _ = matches(spark, [("~x", "Y")], ["{x ~x"], alias={"~": "{"})
    assert got[0] == [(0, "{x")]


def test_positions_columns(spark):
    _, rows = matches(spark, [("é", "E"), ("😀b", "S")], ["aé😀b\n😀bé"])
    got = [(r.ordinal, r.start, r.end, r.length, r.text, r.replacement_id) for r in rows]
    assert sorted(got) == [(0, 1, 2, 1, "é", 0), (1, 2, 4, 2, "😀b", 1),
                           (2, 5, 7, 2, "😀b", 1), (3, 7, 8, 1, "é", 0)]


def test_edge_cases(spark):
    pairs = [("ab", "X"), ("b", "Y")]
    texts = ["", "ab", "abab", "xxab", "abxx", "b"]
    got, _ = matches(spark, pairs, texts)
    assert got.get(0) is None
    assert got[1] == [(0, "ab")] and got[2] == [(0, "ab"), (2, "ab")]
    assert got[3] == [(2, "ab")] and got[4] == [(0, "ab")] and got[5] == [(0, "b")]
    # null text: no match, null rewrite
    df = spark.createDataFrame([(1, None)], "doc_id BIGINT, text STRING")
    cd = compile_dictionary(dictionary_from_pairs(spark, pairs))
    assert search.find_all(df, cd).count() == 0
    r = rewrite.replace_all(df, cd).first()
    assert r.text is None and r.n_matches == 0


def test_empty_dictionary(spark):
    d = dictionary_from_pairs(spark, [("", "x")])
    cd = compile_dictionary(d)
    assert cd.empty and cd.retry_regex is None
    df = texts_df(spark, ["abc", ""])
    assert search.find_all(df, cd).count() == 0
    assert search.find_all(df, cd, mode="walk").count() == 0
    out = {r.doc_id: r.text for r in rewrite.replace_all(df, cd).collect()}
    assert out == {0: "abc", 1: ""}


def test_metacharacters(spark):
    pats = ["$", "\\", "[a]", "a|b", "(?", "^x", "+", "}{"]
    text = "x$\\[a]a|b(?^x+}{"
    pairs = [(p, "_") for p in pats]
    got, _ = matches(spark, pairs, [text])
    assert got[0] == retry(text, pats)


ALPHABET = "abé😀\n "


def random_case(rng, n_texts=150):
    pats = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 7))]
    pairs = [(p, rng.choice(["R", "S", "", "T\n"])) for p in pats]
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n_texts)]
    return pairs, texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_property_retry_walk_rewrite(spark, seed):
    rng = random.Random(seed)
    pairs, texts = random_case(rng)
    fl = first_lines(pairs)
    pats = list(fl)
    got, rows = matches(spark, pairs, texts, "retry")
    for i, t in enumerate(texts):
        assert got.get(i, []) == retry(t, pats), (pairs, t)
    for r in rows:
        assert r.replacement_id == fl[r.text][1]
    got, _ = matches(spark, pairs, texts, "walk")
    for i, t in enumerate(texts):
        assert got.get(i, []) == walk(t, pats), (pairs, t)
    cd = compile_dictionary(dictionary_from_pairs(spark, pairs))
    df = texts_df(spark, texts)
    out = {r.doc_id: r.text for r in rewrite.replace_all(df, cd).collect()}
    ins = {r.doc_id: r.text for r in rewrite.replace_all(df, cd, emit="insert_before").collect()}
    for i, t in enumerate(texts):
        assert out[i] == replace(t, pairs)
        assert ins[i] == replace(t, pairs, insert_before=True)


def test_identity_rewrite_keeps_text(spark):
    rng = random.Random(7)
    pairs, texts = random_case(rng)
    ident = [(p, p) for p, _ in pairs]
    cd = compile_dictionary(dictionary_from_pairs(spark, ident))
    out = {r.doc_id: r.text for r in rewrite.replace_all(texts_df(spark, texts), cd).collect()}
    assert [out[i] for i in range(len(texts))] == texts


@pytest.mark.parametrize("seed", [11, 12])
def test_anchor_join_equals_regex(spark, seed):
    rng = random.Random(seed)
    pairs, texts = random_case(rng, 80)
    d = dictionary_from_pairs(spark, pairs)
    df = texts_df(spark, texts)
    a = anchor.find_all_anchor(df, d, "doc_id", "text", q=2)
    b = search.find_all(df, compile_dictionary(d), "doc_id", "text")
    cols = ["doc_id", "ordinal", "start", "end", "length", "text", "replacement_id"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    # the shuffled variant (patterns not in the tasks) finds the same occurrences
    c1 = anchor.find_candidates(df, d, "doc_id", "text", q=2)
    c2 = anchor.find_candidates(df, d, "doc_id", "text", q=2, broadcast_rows=0)
    assert sorted(map(tuple, c1.collect())) == sorted(map(tuple, c2.collect()))


LINE_BREAK = [("", False), ("  ", False), (" \nx", False), ("x", True), (" x", True)]


@pytest.mark.parametrize("gap,inserted", LINE_BREAK)
def test_line_break_rule(spark, gap, inserted):
    cd = compile_dictionary(dictionary_from_pairs(spark, [("A", "R")]))
    df = texts_df(spark, ["A" + gap + "A" + gap])
    got = rewrite.replace_all(df, cd, line_break=True).first().text
    assert got == "R" + ("\n" if inserted else "") + gap + "R" + gap


def test_report_and_counts(spark):
    pairs = [("test one", "replace one"), ("x", "")]
    cd = compile_dictionary(dictionary_from_pairs(spark, pairs))
    df = texts_df(spark, ["a test one x", "none"])
    rep = {r.doc_id: r.report for r in report.match_report(df, cd).collect()}
    assert rep == {0: "0:  replace one <- 'test one'\n0:   <- 'x'"}
    cnt = {r.doc_id: r.n_matches for r in report.doc_match_counts(df, cd).collect()}
    assert cnt == {0: 2, 1: 0}
    s = report.scan_summary(df, cd).first()
    assert (s.n_docs, s.n_changed, s.n_matches, s.n_chars) == (2, 1, 2, 16)


def test_regex_dictionary(spark):
    rows = [(0, "[0-9]+%", "P"), (1, "a.c", "A"), (2, "ab+", "B")]
    df = texts_df(spark, ["12% a\nc abbb 7%"])
    got = [(r.start, r.text, r.line_no) for r in
           search.find_all_regex(df, rows, "doc_id").orderBy("ordinal").collect()]
    # lazy: 'ab+' stops after one b; '[0-9]+%' must reach the %
    assert got == [(0, "12%", 0), (4, "a\nc", 1), (8, "ab", 2), (13, "7%", 0)]


def test_strategy_paths_agree_on_word_dictionary(spark):
    from paths import SF001
    from multimatch.plans import catalog, strategy
    docs = catalog.documents(spark, SF001)
    words = catalog.benchmark_vocabulary(spark, SF001)
    cols = ["doc_id", "ordinal", "start", "end", "length", "text", "replacement_id"]
    by_regex = strategy.find_all_auto(docs, words).select(cols)
    by_anchor = strategy.find_all_auto(docs, words, max_patterns=0).select(cols)
    a, b = by_regex.collect(), by_anchor.collect()
    assert len(a) > 1000 and sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_contains_pairs_both_ways(spark):
    from paths import SF001
    from multimatch.plans import catalog
    docs = catalog.documents(spark, SF001)
    words = catalog.table(spark, SF001, "benchmark", "item_id", "text").select(
        "item_id", F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).where(F.length("w") > 0)
    words = words.select(F.concat_ws(":", "item_id", "w").alias("k"), "w")
    a = search.contains_pairs(docs, words, "doc_id", "text", "k", "w")   # anchor join
    b = docs.join(words, F.col("text").contains(F.col("w"))).select("doc_id", "k")   # plain theta join
    ra, rb = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert len(ra) > 1000 and ra == rb


def test_lint_filtering_keeps_matches(spark):
    """Dropping duplicate and shadowed lines (T5) does not change find_all (M1)."""
    from multimatch.operators.dictionary import dictionary_lint
    rng = random.Random(5)
    pairs, texts = random_case(rng)
    pairs += [(p + "x", "Z") for p, _ in pairs[:2]] + pairs[:1]
    d = dictionary_from_pairs(spark, pairs)
    bad = {r.line_no for r in dictionary_lint(d).collect()}
    kept = d.where(~F.col("line_no").isin(list(bad))) if bad else d
    df = texts_df(spark, texts)
    cols = ["doc_id", "ordinal", "start", "text", "replacement_id"]
    a = search.find_all(df, compile_dictionary(d)).select(cols).collect()
    b = search.find_all(df, compile_dictionary(kept)).select(cols).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("mode,emit", [("retry", "replace"), ("retry", "insert_before"),
                                       ("walk", "replace"), ("walk", "insert_before")])
def test_line_break_matches_reference_writer(spark, mode, emit):
    from brute import writer
    rng = random.Random(21)
    alphabet = "ab \n"
    pairs = [("ab", "X"), ("b", "Y\n"), (" a", "Z"), ("a a", "W")]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += ["ab  \nab", "ab ab", "abab", "ab   ", " a  b"]
    fl = first_lines(pairs)
    cd = compile_dictionary(dictionary_from_pairs(spark, pairs))
    got = {r.doc_id: r.text for r in rewrite.replace_all(
        texts_df(spark, texts), cd, emit=emit, line_break=True, mode=mode).collect()}
    find = retry if mode == "retry" else walk
    for i, t in enumerate(texts):
        want = writer(t, find(t, list(fl)), {p: v[0] for p, v in fl.items()},
                      insert_before=(emit == "insert_before"))
        assert got[i] == want, (t, got[i], want)


def test_regex_dictionary_from_frame(spark):
    rows = [(0, "[0-9]+%", "P"), (1, "a.c", "A")]
    d = spark.createDataFrame(rows, "line_no INT, pattern STRING, replacement STRING")
    df = texts_df(spark, ["12% abc"])
    a = search.find_all_regex(df, rows, "doc_id").collect()
    b = search.find_all_regex(df, d, "doc_id").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 2
    with pytest.raises(ValueError):
        search.find_all_regex(df, d, "doc_id", max_patterns=0, few=0)  # 'a.c' has no text worth looking up


def test_composite_key(spark):
    from paths import SF001
    from multimatch.plans import catalog, fixtures
    from multimatch.operators.report import match_report
    conv = catalog.table(spark, SF001, "conversations", "conv_id", "turn", "text")
    cd = catalog.compiled_d1(spark)
    ms = search.find_all(conv, cd, ["conv_id", "turn"], "text").collect()
    fl = first_lines(fixtures.D1)
    want = {}
    for r in conv.collect():
        for ordinal, (st, p) in enumerate(retry(r.text or "", list(fl))):
            want[(r.conv_id, r.turn, ordinal)] = (st, p)
    got = {(m.conv_id, m.turn, m.ordinal): (m.start, m.text) for m in ms}
    assert got == want and len(got) > 100
    rep = match_report(conv, cd, ["conv_id", "turn"], "text").first()
    assert rep.report.startswith(f"{rep.conv_id}/{rep.turn}:  ")
