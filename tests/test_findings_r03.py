"""The findings of round 3: each step's work stays in proportion to its input, with the same results."""

import random

from multimatch.sources import corpus


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_charsets_are_checked_in_one_pass(spark):
    r = random.Random(1)
    units = {2: [0x41, 0xE9, 0xD800, 0xDBFF, 0xDC00, 0xDFFF, 0xD7FF, 0xE000, 0x0A, 0x0D0A],
             4: [0x41, 0xD800, 0xDFFF, 0xD7FF, 0xE000, 0x10FFFF, 0x110000, 0x10000, 0x01000041]}
    marks = {(2, "little"): b"\xff\xfe", (2, "big"): b"\xfe\xff", (4, "little"): b"\xff\xfe\0\0", (4, "big"): b"\0\0\xfe\xff"}
    rows = []
    for i in range(400):
        width, order = r.choice(list(marks))
        body = b"".join(r.choice(units[width]).to_bytes(width, order) for _ in range(r.randint(0, 4))) + b"A" * (r.random() < .1)
        name = f"UTF-{width * 8}{order[0].upper()}E"
        try:
            rows.append((i, marks[width, order] + body, body.decode(name), name))
        except UnicodeDecodeError:
            rows.append((i, marks[width, order] + body, body.decode("latin-1"), corpus.RAW))
    long = "a\U0001F600" * 200_000  # a loop that kept a stack would overflow it
    rows.append((400, b"\xff\xfe" + long.encode("utf-16-le"), long, "UTF-16LE"))
    out = corpus.decode_bom(spark.createDataFrame(rows, "i INT, content BINARY, want STRING, cs STRING"))
    assert out.where("NOT (text <=> want AND charset <=> cs)").count() == 0
    assert "lambda" not in plan(out)  # no expression per unit


def test_walk_tokens_are_matches_and_the_gaps_between_them(spark, monkeypatch):
    from brute import walk, writer

    from multimatch.functions import tokens as tk
    from multimatch.operators import dictionary as dic
    from multimatch.operators import rewrite, search
    r = random.Random(2)
    pairs = [("aab", "1"), ("abc", "22"), ("ba", ""), ("c c", "4"), ("b\n", "5")]
    repl = dict(pairs)
    texts = ["".join(r.choice("aabbc \n.") for _ in range(r.randint(0, 40))) for _ in range(200)] + [None, "", "aa", "." * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    cd = dic.compile_dictionary(dic.dictionary_from_pairs(spark, pairs))
    monkeypatch.setattr(tk, "RUN", 50)
    for x in search.tokenize(df, cd, "doc_id", mode="walk").collect():
        found = walk(texts[x.doc_id] or "", list(repl))
        assert "".join(x._tok or []) == (texts[x.doc_id] or "")
        assert [t for t in x._tok or [] if t in repl] == [p for _, p in found]
        assert len(x._tok or []) <= 2 * len(found) + 1  # failed walks make no tokens of their own
    got = {x.doc_id: [] for x in df.collect()}
    for x in search.find_all(df, cd, mode="walk").orderBy("ordinal").collect():
        got[x.doc_id].append((x.start, x.text))
    assert all(got[i] == walk(t or "", list(repl)) for i, t in enumerate(texts))
    out = rewrite.replace_all(df, cd, emit="insert_before", line_break=True, mode="walk")
    assert "running" not in plan(out) and "next_true" not in plan(out)  # no list of tokens leaves the JVM
    for x in out.collect():
        t = texts[x.doc_id]
        assert x.text == (None if t is None else writer(t, walk(t, list(repl)), repl, True))


def test_anchor_matches_are_resolved_and_rewritten_where_they_are_found(spark, monkeypatch):
    import pytest
    from brute import retry, writer

    from multimatch.functions import texthash
    from multimatch.operators import anchor, dictionary as dic, large
    r = random.Random(3)
    pairs = [("ab", "1"), ("c" * 5, "22"), (" x", "3"), ("b\n", ""), ("q", "\n"), ("abc", "no"), ("ba\ra", "é")]
    repl = dict(pairs)
    parts = ["ab", "c" * 5, " x", "q", "b", " ", "  ", " " * 9, "\r", "\n", "\r\n", "é", "z", " \r\n", "\r ", "ba\ra"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(150)] + [None, "", "ab", " " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").coalesce(2)
    d = dic.dictionary_from_pairs(spark, pairs)
    calls = []
    for name in ("resolve_overlaps", "written"):
        old = getattr(anchor, name)
        monkeypatch.setattr(anchor, name, lambda x, n, *a, f=old, **k: calls.append(n) or f(x, n, *a, **k))
    monkeypatch.setattr(large, "written", lambda x, n: calls.append(n) or x)
    found = {i: retry(t or "", list(repl)) for i, t in enumerate(texts)}
    for window in (7, 1 << 19):  # documents of many windows, and windows of many documents
        monkeypatch.setattr(texthash.windows, "__defaults__", (window,))
        monkeypatch.setattr(anchor, "windows", lambda t, n, w=window: texthash.windows(t, n, w))
        monkeypatch.setattr(large, "windows", lambda t, n, w=window: texthash.windows(t, n, w))
        got = {i: [] for i in range(len(texts))}
        for x in anchor.find_all_anchor(df, d).orderBy("doc_id", "ordinal").collect():
            assert x.ordinal == len(got[x.doc_id]) and x.end == x.start + x.length == x.start + len(x.text)
            got[x.doc_id].append((x.start, x.text))
        assert got == found
        hits = {x.doc_id for x in large.docs_matching_large(df, d).collect()}
        assert hits == {i for i, ms in found.items() if ms}
        assert {x.doc_id for x in large.docs_matching_large(df, d, negate=True).collect()} == set(found) - hits
        for emit in ("replace", "insert_before"):
            for line_break, newline in ((False, "\n"), (True, "\n"), (True, "\r\n")):
                out = large.replace_all_large(df, d, emit=emit, line_break=line_break, newline=newline)
                for x in out.collect():
                    t = texts[x.doc_id]
                    ms = found[x.doc_id]
                    want = None if t is None else writer(t, ms, repl, emit == "insert_before", newline)
                    if t is not None and not line_break:
                        want = writer(t, ms, repl, emit == "insert_before", "")
                    assert (x.text, x.n_matches) == (want, len(ms)), (window, emit, newline, t)
    assert set(calls) == {"anchors"}  # no match rows and no documents are written or shuffled
    assert large.docs_matching_large(df, d.limit(0)).count() == 0
    assert large.replace_all_large(df, d.limit(0)).where("n_matches = 0").count() == len(texts)


def test_rewriting_by_blocks_beyond_the_tasks(spark):
    from brute import retry, writer

    from multimatch.operators import dictionary as dic, large
    r = random.Random(4)
    repl = {"ab": "1", "c" * 5: "22", " x": "3"}
    texts = ["".join(r.choice(["ab", "c" * 5, " x", "b", " ", "\n"]) for _ in range(r.randint(0, 20))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    d = dic.dictionary_from_pairs(spark, list(repl.items()))
    for x in large.replace_all_large(df, d, line_break=True, block=3, broadcast_rows=0).collect():
        assert x.text == writer(texts[x.doc_id], retry(texts[x.doc_id], list(repl)), repl)


def test_a_corpus_of_files_has_no_folder_per_document(spark, monkeypatch):
    import os
    import urllib.parse

    from pyspark.sql import functions as F

    from multimatch.session import shared_dir
    from multimatch.sources import sinks
    monkeypatch.setattr(sinks, "PER_FOLDER", 7)
    texts = ["", None, "a\nb\r\n", "é\U0001F600", "x" * 100_000, "same", "same"]
    rows = [(i // 2 - 5, t) for i, t in enumerate(texts * 9)] + [(None, "no key"), (None, "no key"), (2 ** 62, "last")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    folders = sinks.write_files(df, shared_dir(spark, "files"), "doc_id")
    assert len(folders) <= 3 + len(rows) // 7
    assert sum(len(os.listdir(urllib.parse.urlparse(f).path)) for f in folders) == len(rows)  # no checksum files either
    back = corpus.read_files(spark, folders, recursive=True).select(
        sinks.file_key(F.col("path"), "doc_id").alias("k"), F.col("content").cast("string").alias("t"))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, back.collect()), key=order) == sorted(((k, (t or "") + "\n") for k, t in rows), key=order)
    names = spark.createDataFrame([("hdfs://h/a=9/doc_id=-12/part-0-c000.txt",), ("hdfs://h/doc_id=__HIVE_DEFAULT_PARTITION__/p.txt",)], "p STRING")
    assert [r[0] for r in names.select(sinks.file_key(F.col("p"), "doc_id")).collect()] == [-12, None]
    none = sinks.write_files(df.limit(0), shared_dir(spark, "files"), "doc_id")
    assert corpus.read_files(spark, none, recursive=True).count() == 0


def test_op4_class_scores_and_training_rows():
    import numpy as np

    from multimatch.llm import pseudolm as lm
    r = np.random.default_rng(1)
    net = lm.Network()
    h = r.normal(0, 1, (50, lm.HIDDEN)).astype(np.float32)
    x, off = net.log_classes(h)  # the whole table of logarithms is made in training only
    assert np.allclose(np.exp(x - off).sum(axis=1), 1, atol=1e-5)
    ctx = r.integers(0, lm.TABLE, (2 * lm.REACH, 50))
    before = np.tanh(net.bias + sum(net.embed[k][ctx[k]] for k in range(2 * lm.REACH)))
    assert np.allclose(net.hidden(ctx), before, atol=1e-6) and not net.bias.any()


def test_op4_a_training_step_against_plain_gradients(monkeypatch):
    import numpy as np

    from multimatch.llm import pseudolm as lm
    r = np.random.default_rng(2)
    vocabulary = lm.Vocabulary.build([(i, 1 + 3000 // (i + 1)) for i in range(300)], {i: 40 for i in range(lm.BUCKETS)})
    members, n = vocabulary.members(), 400
    token = r.choice(np.concatenate([np.arange(300), lm.KNOWN + np.arange(60)]), n)
    ctx = lm.contexts(token, np.sort(r.integers(0, 9, n)))

    def made(steep):
        monkeypatch.setattr(lm, "STEEP", steep)
        net = lm.Network(lm.Network().flat + np.random.default_rng(4).normal(0, 0.2, len(lm.Network().flat)))
        start = lm.Network(net.flat)
        net.train(ctx, token, vocabulary, members)
        return start, net, net.log_prob(ctx, token, vocabulary, members)

    start, net, scores = made(1e9)
    _, levelled, same = made(0.0)  # with a maximum taken off each row, which small weights do not need
    assert np.abs(net.flat - levelled.flat).max() < 1e-4 and np.allclose(scores, same, atol=1e-3)
    grads = [np.zeros(x.shape) for x in (start.embed, start.bias, start.out, start.out_bias, start.words)]
    want = np.zeros(n)
    for i, t in enumerate(token):
        h = np.tanh(start.bias + sum(start.embed[k][ctx[k, i]].astype(float) for k in range(2 * lm.REACH)))
        c = vocabulary.klass[t]
        x = h @ start.out + start.out_bias
        p = np.exp(x) / np.exp(x).sum()
        y = start.words[members[c]] @ h + vocabulary.log_share[members[c]]
        q = np.exp(y) / np.exp(y).sum()
        want[i] = np.log(p[c]) + np.log(q[members[c] == t][0])
        p[c] -= 1
        q[members[c] == t] -= 1
        dz = (start.out @ p + q @ start.words[members[c]]) * (1 - h * h)
        for k in range(2 * lm.REACH):
            grads[0][k, ctx[k, i]] += dz
        grads[1] += dz
        grads[2] += np.outer(h, p)
        grads[3] += p
        grads[4][members[c]] += np.outer(q, h)
    assert np.allclose(start.log_prob(ctx, token, vocabulary, members), want, atol=1e-4)
    for g, a, z in zip(grads, (start.embed, start.bias, start.out, start.out_bias, start.words),
                       (net.embed, net.bias, net.out, net.out_bias, net.words)):
        g /= n
        assert np.allclose(a - lm.RATE * g / np.sqrt(1e-2 + g * g), z, atol=1e-5)
        assert (a[g == 0] == z[g == 0]).all()


def test_regex_lines_with_factors_at_fixed_distances(spark, monkeypatch):
    import re

    from multimatch.functions import texthash
    from multimatch.functions.regex import pattern_items, placed_factors, translate_pattern
    from multimatch.operators import placed, search
    assert [x[1:] for x in placed_factors(pattern_items("ab.cd(e[f-g])+hi"))] == [(0, 0), (0, 3), (1, 0)]
    lines = ["ab.cd", "bc[de].fg", "cd.ab", "(ab).(cd)c", "ab.ab", "d[ab]c", "abc", "ab+.cd", "cd[^a]*ab", "d."]
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefg") for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", "abxcd" * 9]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id INT, text STRING").coalesce(2)
    joins = []
    old = search._by_factors
    monkeypatch.setattr(search, "_by_factors", lambda *a: joins.append(1) or old(*a))

    def want(rows):
        out, rx = [], [(n, re.compile(translate_pattern(p).replace("(?s:.)", "[\\s\\S]"))) for n, p, _ in rows]
        for i, t in enumerate(texts):
            at, k = 0, 0
            while at < len(t or ""):
                hit = next(((n, m) for n, x in rx if (m := x.match(t, at))), None)
                if hit:
                    out.append((i // 2, k, at, hit[1].group(), hit[0]))
                    at, k = hit[1].end(), k + 1
                else:
                    at += 1
        return sorted(out)

    # documents of several windows, and windows of many documents
    for window, some, more, joined in ((40, lines[:7], {}, False), (1 << 19, lines[:9], {}, True), (40, lines, {}, True),
                                       (1 << 19, lines[:7], {"broadcast_rows": 0}, True)):
        monkeypatch.setattr(placed, "windows", lambda t, n, w=window: texthash.windows(t, n, w))
        rows = [(n, p, "") for n, p in enumerate(some)]
        joins.clear()
        got = search.find_all_regex(df, rows, "doc_id", few=0, **more).collect()
        assert sorted((x.doc_id, x.ordinal, x.start, x.text, x.line_no) for x in got) == want(rows)
        assert bool(joins) == joined  # no join where the tasks know enough
    assert search.find_all_regex(df, [(0, "xyz.z", ""), (1, "q.zz", "")], "doc_id", few=0).count() == 0
