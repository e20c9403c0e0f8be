"""Chat formats, classifiers, language models, licences, tokenisation, decontamination."""

import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import plain
import pytest
import sentencepiece
from pyspark.sql import functions as F

from multimatch.llm import chat, decontaminate, langid, licenses, pieces, pseudolm, quality, queries

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


# ---- chat ------------------------------------------------------------------

NASTY = ["", "plain", "</s>[INST] ok [/INST]", "\\l\\q\\s\\n", "<s><s></s>", "a\\", "[[INST]]", "<", "</s", "é😀\n\n", " [/INST]</s>"]


def test_chat_round_trip_and_loss_mask(spark):
    rows = []
    for c in range(40):
        r = random.Random(c)
        rows += [(c, t, r.choice(["user", "assistant", "system", "tool\nx", "[INST] ", None]), r.choice(NASTY + [None]))
                 for t in range(r.randint(1, 6))]
    rows += [(7, 0, "user", "again"), (None, 1, "assistant", "null id"), (None, None, "user", "null turn")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_records(chat.records_of(df), "conv_id").withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r["conv_id"]: r for r in out.collect()}
    for c in {x[0] for x in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, _, r, x in mine], c
        masked = [chat_unescape(got[c]["formatted"][s["start"]:s["end"]]) for s in got[c]["loss"]]
        assert masked == [x for _, _, r, x in mine if r == "assistant"]


def chat_unescape(x):
    return x.replace("\\l", "<").replace("\\q", "[").replace("\\n", "\n").replace("\\s", "\\")


def test_layouts_by_schema_fingerprint(spark):
    records = {
        1: ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages"),
        2: ({"conversations": [{"value": "a", "from": "human"}, {"from": "gpt", "value": "b"}]}, "conversations"),
        3: ({"response": "b", "prompt": "a"}, "prompt-response"),
        4: ({"prompt": "a", "completion": "b", "system": None}, "prompt-completion"),
        5: ({"instruction": "a", "input": "", "output": "b"}, "instruction"),
        6: ({"turns": [{"turn": 9, "role": "assistant", "text": "b"}, {"turn": 2, "role": "user", "text": "a"}]}, "turns"),
        7: ({"question": "a", "answer": "b"}, None),
        8: ({"messages": []}, None),
    }
    rows = [(k, json.dumps(v), "n") for k, (v, _) in records.items()] + [(9, "{bad", "n"), (10, None, "n"), (1, json.dumps(records[1][0]), "n")]
    df = spark.createDataFrame(rows, "key int, record string, pos string")
    got = {r["key"]: (r["__layout"], [(t["role"], t["text"]) for t in r["__turns"]]) for r in chat.canonical(df).collect()}
    for k, (_, name) in records.items():
        assert got[k] == (name, [("user", "a"), ("assistant", "b")] if name else []), k
    assert got[9] == (None, []) and got[10] == (None, [])
    out = chat.format_records(df, "key")
    assert out.count() == len(rows)
    assert {r["formatted"] for r in out.where("key <= 6").collect()} == {"<s>[INST] user\na [/INST]</s><s>b</s>"}
    assert chat.format_records(df.where("key < 0"), "key").count() == 0


def test_large_records_keep_their_turns(spark):
    rows = spark.range(4).selectExpr(
        "id AS conv_id", "explode(array(0L, 1L, 2L)) AS turn", "if(turn = 1, 'assistant', 'user') AS role").selectExpr(
        "conv_id", "turn", "role", "if(conv_id < 2 AND turn = 1, concat(repeat('ab\"\\\\ ', 4400000), 'end'), 'short') AS text")
    two = spark.sql("SELECT 9L AS conv_id, id AS turn, element_at(array('user', 'assistant'), int(id) + 1) AS role, "
                    "concat(repeat('xy', 11000000), id) AS text FROM range(2)")
    many = spark.range(140).selectExpr("10L AS conv_id", "id AS turn", "'user' AS role", "concat(repeat('z', 1000000), id) AS text")
    df = rows.union(two).union(many)
    out = chat.format_records(chat.records_of(df), "conv_id").select(
        "conv_id", "failed", F.transform(chat.read_back(F.col("formatted")), lambda t: F.sha2(t["text"], 256)).alias("t"))
    got = {r["conv_id"]: (r["failed"], r["t"]) for r in out.collect()}
    want = {}
    for r in df.select("conv_id", F.sha2("text", 256).alias("h")).orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append(r["h"])
    assert got == {k: (False, v) for k, v in want.items()}


def test_unparsed_records_are_reported(spark):
    rows = [(1, "{bad", True), (2, None, False), (3, '{"question": "a"}', False), (4, '{"prompt": "\\q", "response": "b"}', True),
            (5, '{"prompt": "a", "response": "b"}', False), (6, "null", False)]
    df = spark.createDataFrame(rows, "key int, record string, want boolean")
    assert {r["key"]: r["failed"] for r in chat.format_records(df, "key").collect()} == {k: w for k, _, w in rows}


# ---- quality ---------------------------------------------------------------

def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.5) | ((x[:, 1] > 0) ^ (x[:, 2] > 0))).astype(float)
    model = quality.AdditiveModel.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    # a score is the logistic of table entries added one by one
    raw = model.intercept + sum(t[np.searchsorted(e, x[5, f], side="right")] for f, (e, t) in
                                enumerate(zip(model.edges, model.tables)))
    raw += sum(g[np.searchsorted(model.pair_edges[i], x[5, i], side="right"),
                 np.searchsorted(model.pair_edges[j], x[5, j], side="right")] for (i, j), g in model.grids.items())
    assert model.score(x[5:6])[0] == pytest.approx(1 / (1 + np.exp(-raw)))
    assert quality.AdditiveModel.fit(np.empty((0, 4)), np.empty(0)).score(x[:3]).tolist() == [0.5] * 3


def test_quality_of_held_out_documents(spark):
    got = queries.LLM_QUERIES["op3_quality"](spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert got.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()


def test_quality_features_of_odd_texts(spark):
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, " \n", 3), (None, "x" * 100_000, 4), (5, "😀 é", 5), (5, "😀 é", 5)],
                                "doc_id bigint, text string, x int")
    table = quality.feature_table(odd)
    assert {len(r["x"]) for r in table.collect()} == {len(quality.FEATURES)}
    model = quality.learn(table, spark.createDataFrame([(5, 1), (5, 0), (2, None)], "doc_id bigint, quality int"))
    scores = [r["score"] for r in quality.score_table(table, model).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert quality.score_table(table.where("id < 0"), model).count() == 0


def test_letters_late_in_a_word_count():
    at = quality.FEATURES.index("words_without_letter")
    assert quality.features(b"1234567890123456789z ============/a 123 -- \xc3\xa9")[at] == 2 / 5
    assert quality.features(b"1234567890123456789")[at] == 1.0


# ---- pseudo-likelihood -------------------------------------------------------

def test_pseudo_likelihood_against_loops(spark):
    rows = [(1, "the cat sat on the mat"), (2, ""), (3, None), (4, " \n"), (5, "the"), (None, "cat the"), (1, "the cat sat on the mat")]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id bigint, text string, n_tokens string")
    vocabulary = pseudolm.learn_vocabulary(docs)
    net = pseudolm.train(docs, vocabulary)
    assert np.abs(net.flat - pseudolm.Network().flat).max() > 0
    got = {(r["id"], r["n_tokens"]): r["log_prob"] for r in pseudolm.score(docs, vocabulary, net).collect()}
    for i, t in rows:
        token, _ = vocabulary.encode([(t or "").encode()])
        total = 0.0
        for k, x in enumerate(token):
            z = net.bias.astype(float).copy()
            for row, off in enumerate((-2, -1, 1, 2)):
                j = k + off
                z += net.embed[row][token[j] if 0 <= j < len(token) else pseudolm.EDGE]
            logit = np.tanh(z) @ net.out + net.out_bias
            logit -= logit.max()
            total += logit[vocabulary.klass[x]] - np.log(np.exp(logit).sum()) + vocabulary.log_share[x]
        assert got[i, len(token)] == pytest.approx(total, abs=1e-4)
    share = np.bincount(vocabulary.klass, np.exp(vocabulary.log_share))
    assert np.allclose(share[share > 0], 1)
    assert pseudolm.pseudo_likelihood(docs.where("doc_id > 9")).count() == 0


def test_word_order_is_learned(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "BATCH", 128)
    r = random.Random(2)
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs = spark.createDataFrame([(i, " ".join(line * 40)) for i in range(30)], "doc_id bigint, text string")
    vocabulary = pseudolm.learn_vocabulary(docs)
    net = pseudolm.train(docs, vocabulary)
    mixed = line * 40
    r.shuffle(mixed)
    two = spark.createDataFrame([(1, " ".join(line * 40)), (2, " ".join(mixed))], "doc_id bigint, text string")
    s = {x["id"]: x["log_prob"] for x in pseudolm.score(two, vocabulary, net).collect()}
    assert s[1] > s[2] + 100


def test_within_a_class_against_loops(spark, monkeypatch):
    """Classes of several tokens: the class, then the token in it, both by hand."""
    monkeypatch.setattr(pseudolm, "CLASSES", 2)
    r = random.Random(3)
    words = ["the", "cat", "sat", "on", "a", "mat", "dog", "ran"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocabulary = pseudolm.learn_vocabulary(docs)
    members = [np.flatnonzero((vocabulary.klass == c) & np.isfinite(vocabulary.log_share)) for c in range(2)]
    assert all(len(m) > 1 for m in members)
    net = pseudolm.train(docs, vocabulary)
    got = {x["id"]: x["log_prob"] for x in pseudolm.score(docs, vocabulary, net).collect()}
    for i, t in rows:
        token, _ = vocabulary.encode([t.encode()])
        total = 0.0
        for k, x in enumerate(token):
            z = net.bias.astype(float).copy()
            for row, off in enumerate((-2, -1, 1, 2)):
                j = k + off
                z += net.embed[row][token[j] if 0 <= j < len(token) else pseudolm.EDGE]
            h, c = np.tanh(z), vocabulary.klass[x]
            logit = h @ net.out + net.out_bias
            inner = net.words[members[c]] @ h + vocabulary.log_share[members[c]]
            total += logit[c] - np.log(np.exp(logit).sum())
            total += inner[members[c] == x][0] - np.log(np.exp(inner).sum())
        assert got[i] == pytest.approx(total, abs=1e-4)


def test_very_long_text(spark):
    r = random.Random(4)
    text = " ".join(f"w{int(r.paretovariate(0.6)) % 9000}" for _ in range(500_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id bigint, text string")
    vocabulary = pseudolm.learn_vocabulary(docs)
    net = pseudolm.train(docs, vocabulary)
    got = {x["id"]: x for x in pseudolm.score(docs, vocabulary, net).collect()}
    token, doc, h = vocabulary.words([text.encode()])
    want = net.log_prob(pseudolm.contexts(token, doc), token, vocabulary, vocabulary.members())
    count = Counter(h.tolist())
    rare = token >= pseudolm.KNOWN
    want[rare] += np.log([count[x] for x in h[rare].tolist()]) - vocabulary.log_size[token[rare] - pseudolm.KNOWN]
    assert got[1]["n_tokens"] == 500_000 and got[1]["log_prob"] == pytest.approx(want.sum(), rel=1e-6)


@pytest.mark.parametrize("frequent", [pseudolm.FREQUENT, 10])
def test_every_word_has_its_own_count(spark, monkeypatch, frequent):
    monkeypatch.setattr(pseudolm, "FREQUENT", frequent)  # fewer: more of the counts are joined
    common = [f"w{i}" for i in range(pseudolm.KNOWN)]
    others = [f"x{i}" for i in range(3000)]
    text = common * 9 + [w for i, w in enumerate(others) for _ in range(1 + i % 8)]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string")
    vocabulary = pseudolm.learn_vocabulary(docs)
    assert vocabulary.rare.count() == len(others)
    net = pseudolm.train(docs, vocabulary)
    alone = others + ["neverseen", f"{others[0]} {others[1]} w5"]
    rows = spark.createDataFrame(list(enumerate(alone)) * 2, "doc_id bigint, text string")
    scored = pseudolm.score(rows, vocabulary, net).collect()
    assert len(scored) == 2 * len(alone)
    got = {r["id"]: r["log_prob"] for r in scored}
    token, _ = vocabulary.encode([w.encode() for w in others])
    assert (token >= pseudolm.KNOWN).all()
    groups = {}
    for i, t in enumerate(token):
        groups.setdefault(t, []).append(i)
    for mine in groups.values():  # words of one bucket differ by their counts
        for i in mine[1:]:
            assert got[i] - got[mine[0]] == pytest.approx(np.log((1 + i % 8) / (1 + mine[0] % 8)), abs=1e-6)
    t = vocabulary.encode([b"neverseen"])[0][0]
    i = groups[t][0]
    assert got[len(others)] - got[i] == pytest.approx(np.log(pseudolm.UNSEEN / pseudolm.BUCKETS / (1 + i % 8)), abs=1e-6)


def test_words_of_a_class_depend_on_the_context():
    n = 2000
    vocabulary = pseudolm.Vocabulary.build([(i, 10) for i in range(n)], {})
    members = vocabulary.members()
    a, b = members[20][:2]
    assert vocabulary.log_share[a] == vocabulary.log_share[b]
    r = np.random.default_rng(3)
    first = r.integers(0, 2, 20000)
    token = np.stack([np.where(first, members[40][0], members[50][0]), np.where(first, a, b)], 1).ravel()
    doc = np.repeat(np.arange(20000), 2)
    ctx, net = pseudolm.contexts(token, doc), pseudolm.Network()
    for k in range(0, len(token), 256):
        net.train(ctx[:, k:k + 256], token[k:k + 256], vocabulary, members)
    wrong = token.copy()
    wrong[1::2] = np.where(first, b, a)
    right, other = (net.log_prob(ctx, t, vocabulary, members)[1::2] for t in (token, wrong))
    assert (right > other + 1).all()
    every = np.flatnonzero(np.isfinite(vocabulary.log_share))  # all probabilities of one place add up to one
    one = net.log_prob(np.repeat(ctx[:, 1:2], len(every), axis=1), every, vocabulary, members)
    assert np.exp(one).sum() == pytest.approx(1, abs=1e-4)


# ---- language ----------------------------------------------------------------

def test_filters_return_all_languages_and_correct_false_positives():
    r = np.random.default_rng(1)
    grams = {f"l{k:02}": r.integers(0, 1 << 60, 500, dtype=np.uint64) for k in range(70)}
    grams["l69"][:100] = grams["l03"][:100]
    f = langid.LanguageFilters.build(grams)
    seen = f.counts(grams["l03"], np.zeros(500, np.int64), 1)[0]
    assert seen[3] == 500 and seen[69] >= 100 and f.words.shape[0] == 2
    other = np.delete(seen, [3, 69])
    assert abs(other.mean() - 500 * f.false_rate.mean()) < 5


def test_languages_of_held_out_documents(spark):
    got = queries.LLM_QUERIES["op5_langid"](spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99


def test_languages_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (3, "der Hund und die Katze", "de"), (4, None, "en"),
                                  (5, "x", None)], "doc_id bigint, text string, lang string")
    f = langid.train(docs.select("lang", "text"))
    assert f.languages == ["de", "en"]
    odd = [None, "", "123 !?", "the dog", "und der Hund", "the " * 200_000, "İ"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(odd)] + [(None, "the", "k")],
                               "doc_id bigint, text string, gram string")
    got = {r["doc_id"]: (r["__lang"], r["__lang_score"]) for r in langid.identify(df, f).collect()}
    assert [got[i][0] for i in range(6)] == ["und"] * 3 + ["en", "de", "en"] and got[0][1] == 0 and got[None][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.train(docs.where("lang = 'zz'").select("lang", "text"))
    assert {r["__lang"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.where("doc_id > 99"), f).count() == 0


def test_languages_against_plain_sets(spark):
    """Every prediction from sets of trigrams, counted one by one."""
    r = random.Random(8)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "klmnop", "dd": "aeiou"}
    rows = [(k, " ".join("".join(r.choice(letters[name]) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 60))), name)
            for k in range(240) for name in [r.choice(sorted(letters))]]
    rows += [(900, "abc def", None), (901, None, "aa"), (902, "", "bb"), (903, "123 .", "cc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    grams = {}
    for i, t, name in rows:
        if name and t and zlib.crc32(str(i).encode()) % 3 != 1:
            grams.setdefault(name, Counter()).update(plain_trigrams(t))
    total = {n: sum(c.values()) for n, c in grams.items()}
    sure = Counter()
    for n, c in grams.items():
        for g, k in c.items():
            sure[g] = max(sure[g], (k - langid.SURE * k ** 0.5) / total[n])
    sets = {n: {g for g, k in c.items() if k / total[n] >= langid.REL_RATE * sure[g]} for n, c in grams.items()}
    learned = langid.language_trigrams(df.where(~langid.held_out("doc_id")).select("lang", "text"))
    per = Counter(x["lang"] for x in learned.collect())
    assert per == Counter({n: len(x) for n, x in sets.items()})
    filters = langid.learn_from(df)
    got = {x["doc_id"]: (x["__lang"], x["__lang_score"]) for x in langid.identify(df, filters).collect()}
    sure_of = 0
    for i, t, _ in rows:
        mine = plain_trigrams(t or "")
        if not mine:
            assert got[i] == ("und", 0.0)
            continue
        count = {n: sum(g in x for g in mine) for n, x in sets.items()}
        top = sorted(count.values())[-2:]
        if top[1] - top[0] > 2 + 0.02 * len(mine):
            best = max(count, key=count.get)
            assert got[i][0] == best and got[i][1] == pytest.approx(count[best] / len(mine), abs=0.02)
            sure_of += 1
    assert sure_of > 100


def plain_trigrams(text):
    low = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else "" for c in text]
    return [(low[k - 1] if k else "", c, low[k + 1] if k + 1 < len(low) else "") for k, c in enumerate(low) if c]


def test_a_short_text_in_another_language_takes_nothing_away(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'en' AND length(text) > 3000").orderBy("doc_id").limit(1)
    extra = one.select(F.lit(3_000_000).cast("long").alias("doc_id"), F.substring("text", 500, 400).alias("text"), F.lit("xx").alias("lang"))
    more = docs.unionByName(extra.withColumn("doc_id", F.expr(
        "(SELECT min(id) FROM range(3000000, 3000100) WHERE crc32(cast(id AS string)) % 3 <> 1)")))
    wrong = langid.identify(docs, langid.learn_from(more)).where(
        langid.held_out("doc_id") & (F.col("lang") == "en") & (F.col("__lang") != "en")).count()
    assert wrong == 0


# ---- licences ----------------------------------------------------------------

def test_license_scan(spark):
    long = "x y z\n" * 3000
    files = [
        (1, "a/LICENSE", "intro\nReleased under the MIT License."), (2, "a/b/c/x.txt", "nothing"), (3, "a/b/LICENSE.md", "nothing"),
        (4, "a/b/y.txt", long + "# All rights reserved.\nmore"), (5, "z.txt", None), (6, "ab/x.txt", "License"), (7, None, "all rights reserved"),
        (8, "q/COPYING", "Licensed under the Apache License,\nVersion 2.0."), (9, "q/r/s.c", ""), (10, "LICENCE", "Licensed under CC BY-NC 4.0."),
        (2, "a/b/c/x.txt", "nothing"), (None, "q/t.c", "x"),
    ]
    df = spark.createDataFrame([(i, p, t, "c", "d") for i, p, t in files], "id bigint, path string, text string, copy string, dir string")
    got = sorted({str((r["id"], r["own"], r["license"], r["inherited_from"])) for r in licenses.license_scan(df).collect()})
    assert got == sorted(map(str, [
        (1, "MIT", "MIT", None), (2, None, "MIT", "a"), (3, None, "MIT", "a"), (4, "proprietary", "proprietary", None),
        (5, None, "CC-BY-NC-4.0", ""), (6, None, "CC-BY-NC-4.0", ""), (7, "proprietary", "proprietary", None),
        (8, "Apache-2.0", "Apache-2.0", None), (9, None, "Apache-2.0", "q"), (10, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        (None, None, "Apache-2.0", "q")]))
    assert licenses.license_scan(df).count() == len(files)
    assert licenses.license_scan(df.where("id > 99")).count() == 0


GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() {}
"""
APACHE_HEADER = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy elsewhere.
import os
"""


def test_headers_over_lines_sentences_and_whole_texts(spark):
    filler = "".join(f"section {i} of the agreement covers matter number {i} at length\n" for i in range(400))
    gpl = ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n"
           " Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n" + filler)
    mit = licenses.TEXTS[0][1].replace("Copyright (c).", "Copyright (c) 2019 Some Body\n").replace(", ", ",\n")
    files = [
        (1, "src/a.c", "x\n" * 50 + GPL_HEADER + "y\n" * 50), (2, "src/b.py", APACHE_HEADER), (3, "a/LICENSE", gpl),
        (4, "a/b/c.txt", "nothing here"), (5, "m/LICENSE.txt", mit), (6, "m/x.py", "print(1)"),
        (7, "p/q.txt", "Copyright (c) 2020 Foo Corp. All rights reserved. " + "more words follow in this paragraph " * 20),
        (8, "p/r.txt", "the word license alone, and a program that can be used"), (9, "s/t.txt", "word " * 200_000 + "All rights reserved."),
    ]
    df = spark.createDataFrame(files, "id bigint, path string, text string")
    got = {r["id"]: (r["own"], r["license"], r["inherited_from"]) for r in licenses.license_scan(df).collect()}
    assert got == {1: ("GPL-3.0",) * 2 + (None,), 2: ("Apache-2.0",) * 2 + (None,), 3: ("GPL-3.0",) * 2 + (None,),
                   4: (None, "GPL-3.0", "a"), 5: ("MIT", "MIT", None), 6: (None, "MIT", "m"),
                   7: ("proprietary", "proprietary", None), 8: (None, None, None), 9: (None, None, None)}


def test_scores_equal_plain_cosines(spark):
    vectors, idf, unseen = licenses.template_vectors()
    r = random.Random(6)
    words = sorted(idf) + ["foo", "bar", "_", "2020"]
    texts = []
    for k in range(60):
        notice = r.choice(licenses.NOTICES)[1].split(" ")
        for _ in range(r.randint(0, 4)):
            notice.insert(r.randint(0, len(notice)), r.choice(words))
        texts.append("\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(3)) + "\n"
                     + "".join(w + r.choice([" ", " ", "\n// "]) for w in notice))
    files = [(k, f"d{k}/" + ("LICENSE" if k % 7 == 0 else "x.txt"), t) for k, t in enumerate(texts)]
    notices = vectors[:len(licenses.NOTICES)]
    mark = re.compile(licenses.mark_regex(notices, licenses.THRESHOLD))

    def best(path, text):
        lines = text.lower().split("\n")
        at = [i for i, x in enumerate(lines) if mark.search(x)]
        units = [("\n".join(lines[i:j + 1]), notices) for i in at for j in at if i <= j < i + licenses.WINDOW]
        units += [(x, notices) for x in re.split(licenses.SENTENCE_END, text.lower())]
        units += [(text.lower(), vectors)] if path.endswith("LICENSE") else []
        found = []
        for body, templates in units:
            w = {t: n * idf.get(t, unseen) for t, n in licenses._terms(body).items()}
            norm = sum(x * x for x in w.values()) ** 0.5
            for k, v in enumerate(templates):
                score = round(sum(x * v.get(t, 0) for t, x in w.items()) / norm, licenses.DIGITS) if norm else 0
                if score >= licenses.THRESHOLD:
                    found.append((-score, licenses.TEMPLATES[k][0]))
        return min(found, default=(None, None))

    df = spark.createDataFrame(files, "id bigint, path string, text string")
    got = {x["id"]: (x["own"], x["score"]) for x in licenses.license_scan(df).collect()}
    found = 0
    for k, path, text in files:
        score, name = best(path, text)
        assert got[k][0] == name and (name is None or abs(got[k][1] + score) < 1e-8), (k, text)
        found += name is not None
    assert found > 20


def test_underscores_end_terms(spark):
    df = spark.createDataFrame([(1, "a/x.h", "#define ALL_RIGHTS_RESERVED"), (2, "a/y.h", "_all_rights_reserved_"), (3, "a/z.h", "allrightsreserved")],
                               "id int, path string, text string")
    assert {r["id"]: r["own"] for r in licenses.license_scan(df).collect()} == {1: "proprietary", 2: "proprietary", 3: None}


def test_prefix_terms_lose_no_match():
    vectors, idf, unseen = licenses.template_vectors()
    marks = set(licenses.prefix_terms(vectors, licenses.THRESHOLD))
    r = random.Random(0)
    terms = sorted(idf)
    for _ in range(4000):
        v = r.choice(vectors)
        unit = {t: idf.get(t, unseen) for t in r.sample(sorted(v), r.randint(1, len(v))) + r.sample(terms, r.randint(0, 3))}
        norm = sum(x * x for x in unit.values()) ** 0.5
        if max(sum(w * u.get(t, 0) for t, w in unit.items()) for u in vectors) / norm >= licenses.THRESHOLD:
            assert marks & set(unit)
            assert any(len(set(u) & set(unit)) >= licenses.terms_needed(u, licenses.THRESHOLD) for u in vectors)


# ---- pieces -------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def odd_texts():
    r = random.Random(1)
    out = ["", " ", "   ", "a", "  lead", "trail  ", "é😀你好ab", "a" * 300, "ab" * 300, " " * 40 + "x", "\t\r\n", "-" * 200, "你好世界" * 60]
    out += ["".join(r.choice(" aeitn.shor-,\n  é世=") for _ in range(r.randint(0, 80))) for _ in range(600)]
    return out + ["".join(r.choice("abcdefgh") for _ in range(3000)), "word " * 5000]


def test_pieces_equal_the_library(library):
    model = pieces.read_model()
    for t in odd_texts():
        ids = model.encode(t)
        assert list(ids) == library.encode(t), t
        assert model.decode(ids) == library.decode(library.encode(t)) == t


def test_long_streams_commit_early(library):
    model = pieces.read_model()
    text = "▁" + "".join(random.Random(3).choice("etaoinshrdlu") for _ in range(4000))
    stream = model.segment(text)
    first = next(stream)
    assert "".join([first, *stream]) == text
    assert [model.id_of[p] for p in model.segment(text)] == library.encode(text[1:])


def test_unigram_search_against_all_segmentations():
    def message(number, body):
        return bytes([number << 3 | 2]) + (len(body).to_bytes(1, "little") if len(body) < 128 else
                                            bytes([len(body) & 127 | 128, len(body) >> 7])) + body
    import struct
    scores = {"▁": -2.0, "a": -1.5, "b": -1.4, "ab": -2.2, "ba": -3.1, "▁a": -2.5, "aba": -3.3, "bb": -9.0}
    data = message(1, message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + b"\x18\x02")
    for p, s in scores.items():
        data += message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s))
    data += message(2, b"\x18\x01")
    model = pieces.PieceModel(data)
    assert model.method == pieces.UNIGRAM

    def best(t):
        if not t:
            return 0.0
        return max((scores[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in scores), default=float("-inf"))

    r = random.Random(5)
    for _ in range(200):
        t = "▁" + "".join(r.choice("ab") for _ in range(r.randint(0, 14)))
        got = list(model.segment(t))
        assert "".join(got) == t and sum(scores[p] for p in got) == pytest.approx(best(t))
    assert model.encode("axxb").tolist() == [model.id_of["▁a"], 0, model.id_of["b"]]


def test_encode_documents(spark):
    texts = [None, "", "x", "x", "two\nlines  here", "long " * 50_000]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    out = pieces.encode_documents(df, pieces.read_model())
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["__decoded"] for i in range(6)] == [t or "" for t in texts] and got[0]["__ids"] == []
    assert pieces.encode_documents(df.where("doc_id > 99"), pieces.read_model()).count() == 0


# ---- decontamination -----------------------------------------------------------

def leak_case():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdef") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 13, 14, 9, 8, 5, 1, 12, 25])]
    items += [(20, ""), (21, None), (22, items[0][1]), (None, items[1][1])]
    docs = []
    for k, (_, t) in enumerate(items[:9]):
        for subs in (0, 1, 2, 3, 5):
            w = t.split()
            for p in r.sample(range(len(w)), min(subs, len(w))):
                w[p] = "zzz"
            docs.append((len(docs), " ".join([word() for _ in range(20)] + w + [word() for _ in range(15)])))
        docs.append((len(docs), " ".join(t.upper().split()[2:]) + "\n" + word()))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[8][1] * 1), (None, items[0][1]), (903, "word " * 20_000 + items[0][1])]
    return docs, items


def test_masks_hit_every_window_with_two_substitutions():
    from itertools import combinations
    for gone in combinations(range(13), 2):
        assert any(not {o + m for m in mask} & set(gone) for mask in decontaminate.MASKS for o in range(13 - mask[-1]))


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_overlaps_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_SEEDS", limit)
    docs, items = leak_case()
    d = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id bigint, text string, key int, copy string")
    b = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id bigint, text string, words string")
    got = {(r["id"], r["item_id"]) for r in decontaminate.overlaps(d, b).collect()}
    want = plain.leaks(docs, [(i, t) for i, t in items if i is not None and i != 22])
    assert got == want and len(want) > 30
    left = decontaminate.decontaminate(d, b)
    bad = {i for i, _ in want}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    assert decontaminate.overlaps(d.where("doc_id < 0"), b).count() == 0
    assert decontaminate.overlaps(d, b.where("item_id < 0")).count() == 0


# ---- SQL and the registry ------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.LLM_ORACLE))
def test_sql_oracles(spark, name):
    import sys
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import oracle_check
    con = duckdb.connect()
    for t in oracle_check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = oracle_check.compare(spark, con, name, queries.LLM_QUERIES[name], queries.LLM_ORACLE[name], SF)
    assert res["cols_match"] and res["values_match"], res


def test_every_operator_has_a_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.LLM_QUERIES)
    assert numbers == list(range(1, 14))
