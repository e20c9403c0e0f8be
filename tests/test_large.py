"""Dictionaries and regex dictionaries of any size: rewriting by blocks, counts, factors, logs, numbered lines."""

import os
import random
import re

import pytest
from brute import retry, walk, writer

from multimatch.functions.regex import RegexDialectError, factors, items_regex, pattern_items
from multimatch.operators import dictionary as dic
from multimatch.operators import large, report, rewrite, search
from multimatch.session import shared_dir
from multimatch.sources import dictionary_file as files
from multimatch.sources import sinks


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("emit", ["replace", "insert_before"])
@pytest.mark.parametrize("mode,find", [("retry", retry), ("walk", walk)])
def test_rewriting_by_blocks_equals_the_writer(spark, newline, emit, mode, find):
    r = random.Random(f"{newline!r} {emit} {mode}")
    pairs = [("ab", "1"), ("c" * 11, "22"), (" x", "3"), ("b\n", ""), ("q", "\n")]
    repl = dict(pairs)
    pieces = ["ab", "c" * 11, " x", "q", "b", " ", "  ", " " * 9, "\r", "\n", "\r\n", "é", "z", " \r\n", "\r "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(150)] + [None, "", "ab", " " * 40]
    df, d = frame(spark, texts), dic.dictionary_from_pairs(spark, pairs)
    for block in (3, 7):
        out = large.replace_all_large(df, d, emit=emit, line_break=True, newline=newline, mode=mode, block=block).collect()
        got = {x.doc_id: (x.text, x.n_matches) for x in out}
        for i, t in enumerate(texts):
            found = find(t or "", list(repl))
            want = None if t is None else writer(t, found, repl, emit == "insert_before", newline)
            assert got[i] == (want, len(found)), (block, t)
    plain = large.replace_all_large(df, d, emit=emit, mode=mode, block=4)
    want = rewrite.replace_all(df, dic.compile_dictionary(d), emit=emit, mode=mode)
    assert sorted(map(str, plain.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("mode", ["retry", "walk"])
def test_one_call_for_dictionaries_of_any_size(spark, monkeypatch, mode):
    rows = [(1, "abc x  \nabcde cde"), (1, "cde"), (None, "abcabc  ab"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id INT, text STRING")
    d = dic.dictionary_from_pairs(spark, [("abc", "1"), ("cde", "22"), ("ab", "3"), ("x", ""), ("cde", "9")])
    cd = dic.compile_dictionary(d)
    calls = [(search.find_all, {"mode": mode}), (rewrite.replace_all, {"mode": mode}),
             (report.doc_match_counts, {"mode": mode}), (report.changed_docs_count, {"mode": mode}),
             (report.match_report, {"mode": mode}), (report.scan_summary, {"mode": mode})]
    if mode == "retry":
        calls += [(search.docs_matching, {}), (search.docs_not_matching, {})]
    want = [sorted(map(str, f(df, cd, **kw).collect())) for f, kw in calls]
    hits = sorted(map(str, report.pattern_hit_counts(df, cd, d, mode=mode).collect()))
    limits = [{}, {"max_patterns": 2}, {"max_chars": 3}]
    for limit in limits:
        compile_ = dic.compile_dictionary
        with monkeypatch.context() as m:
            m.setattr(dic, "compile_dictionary", lambda x, **kw: compile_(x, **{**kw, **limit}))
            assert (dic.compiled_or_none(d, mode) is None) == bool(limit)
            for (f, kw), w in zip(calls, want):
                assert sorted(map(str, f(df, d, **kw).collect())) == w, (limit, f.__name__)
            assert sorted(map(str, report.pattern_hit_counts(df, None, d, mode=mode).collect())) == hits


def test_long_replacements_are_measured_before_they_are_collected(spark):
    d = spark.range(3).selectExpr("cast(id as int) line_no", "concat('p', id) pattern", "repeat('r', 1000000) replacement",
                                  "0 replacement_id")
    assert dic.compiled_or_none(d) is None


def scan(text, lines):
    """Leftmost, then earliest line, from every start anew."""
    out, i = [], 0
    rx = [(n, re.compile("(?s)" + items_regex(pattern_items(p)).replace("\\x{", "\\x{"))) for n, p in lines]
    while i < len(text):
        hit = next(((n, m.group()) for n, x in rx if (m := x.match(text, i))), None)
        if hit:
            out.append((i, hit[1], hit[0]))
            i += len(hit[1])
        else:
            i += 1
    return out


def python_regex(monkeypatch):
    from multimatch.functions import regex as rx
    monkeypatch.setattr(rx, "atom", lambda c: re.escape(c))


def test_factors_are_contained():
    r = random.Random(2)
    parts = ["a", "b", "[a-c]", "[^a]", ".", "(ab)", "(a[bc]+d)+", "(cd)*", "a+", "b*", "[a-z]", "\\.", "[a-h][a-h][a-h]"]
    for _ in range(300):
        items = pattern_items("".join(r.choice(parts) for _ in range(r.randint(1, 5))))
        fs = factors(items)

        def sample(items):
            out = ""
            for i in items:
                n = {"": 1, "+": r.randint(1, 3), "*": r.randint(0, 2)}[i.quantifier]
                for _ in range(n):
                    out += sample(i.group) if i.group is not None else r.choice(i.chars or "axyz." if i.atom[:2] != "[^" else "bxyz")
            return out
        for _ in range(5):
            text = sample(items)
            assert all(any(t in text for t in f) for f in fs), (items_regex(items), text, fs)
        assert all(len({len(t) for t in f}) == 1 for f in fs)


def test_regex_lines_by_factors_equal_line_by_line(spark, monkeypatch):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    lines = [(i, p) for i, p in enumerate(
        ["al.ha", "[bg]eta", "(ta)+ ", "gam+a", "x[0-9]+y", "k.p*a d", "..z", "[a-e]me[f-h]a", "delta", "de", "o.*a"])]
    lines += [(len(lines) + i, f"never{i}[a-z]+again{i}") for i in range(300)]
    texts = [" ".join(r.choice(words + ["x12y", "zz!z", "kppa d"]) for _ in range(r.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "never7xagain7 never7xagain8"]
    df = frame(spark, texts)
    rows = [(n, p, "r") for n, p in lines]
    d = spark.createDataFrame(rows, "line_no INT, pattern STRING, replacement STRING")
    got = sorted((x.doc_id, x.ordinal, x.start, x.text, x.line_no) for x in search.find_all_regex(df, d, "doc_id").collect())
    python_regex(monkeypatch)
    want = [(i, k, *m) for i, t in enumerate(texts) for k, m in enumerate(scan(t or "", lines))]
    assert got == sorted(want)


def test_regex_lines_that_match_the_empty_text_are_rejected(spark):
    rows = [(0, "a*", "r"), (1, "cd", "r"), (2, "(a", "r"), (3, "(x*)+", "r")]
    df = frame(spark, ["xxcdyaaacd"])
    assert [(x.start, x.text) for x in search.find_all_regex(df, rows, "doc_id").orderBy("start").collect()] == [
        (2, "cd"), (8, "cd")]
    bad = {x.line_no: (x.line, x.reason) for x in search.regex_rejects(rows, spark).collect()}
    assert bad == {0: ("a*", "matches the empty text"), 2: ("(a", "unbalanced ("), 3: ("(x*)+", "matches the empty text")}


def test_log_rows_and_live_counters(spark):
    df = frame(spark, ["a\nb c", "zz", "c"])
    cd = dic.compile_dictionary(dic.dictionary_from_pairs(spark, [("a\nb", "\\"), ("c", "r")]))
    lines = report.match_lines(df, cd)
    assert {(x.doc_id, x.ordinal, x.line) for x in lines.collect()} == {
        (0, 0, "0:  \\ <- 'a\nb'"), (0, 1, "0:  r <- 'c'"), (2, 0, "2:  r <- 'c'")}
    path = sinks.write_log(lines, shared_dir(spark, "log"))
    assert sorted(x.value for x in spark.read.text(path).collect()) == [
        "0:  \\\\ <- 'a\\nb'", "0:  r <- 'c'", "2:  r <- 'c'"]
    assert sinks.write_log(lines.where("doc_id = 9"), shared_dir(spark, "log")) == ""
    out, counters = report.observed(rewrite.replace_all(df, cd))
    assert out.count() == 3 and counters.get == {"n_docs": 3, "n_changed": 2, "n_matches": 3}


def test_lines_are_numbered_from_one_read(spark):
    root = shared_dir(spark, "lines")
    os.makedirs(root)
    n = 40_000
    for k in range(2):
        with open(f"{root}/{k}.txt", "w") as f:
            f.writelines(f'"p{k * n + i}" "r"\n' for i in range(n))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism")
           if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        lines = files.numbered_lines(spark, root)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150000")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
        got = lines.selectExpr("count(*)", "count(distinct line_no)", "min(line_no)", "max(line_no)",
                               "count_if(line <> concat('\"p', line_no, '\" \"r\"'))").first()
        assert tuple(got) == (2 * n, 2 * n, 0, 2 * n - 1, 0)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        for k, v in old.items():
            spark.conf.set(k, v)


def test_decoded_files_number_on(spark):
    root = shared_dir(spark, "decoded")
    os.makedirs(root)
    for k, (mark, cs) in enumerate([(b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8"), (b"", "utf-8")]):
        with open(f"{root}/{k}.txt", "wb") as f:
            f.write(mark + f'"a{k}" "x"\n"b{k}" "y"'.encode(cs) + (b"" if k else "\n".encode(cs)))
    with open(f"{root}/1b.txt", "wb"):
        pass
    d = files.load_dictionary(spark, root, decode=True).orderBy("line_no").collect()
    assert [(x.line_no, x.pattern) for x in d] == list(enumerate(["a0", "b0", "a1", "b1", "a2", "b2"]))
    with open(f"{root}/2.txt", "ab") as f:
        f.write(b"\nno marks")
    assert [tuple(x) for x in files.dictionary_rejects_file(spark, root, decode=True).collect()] == [
        (6, "no marks", "no marks")]
