"""Anchor join and overlap resolution: long patterns, shared anchors, chains, windows and segments."""

import random

import numpy as np
import pytest
from brute import retry

from multimatch.functions import texthash
from multimatch.operators import anchor
from multimatch.operators.dictionary import dictionary_from_pairs


def every(text, patterns):
    return sorted((i, p) for p in set(patterns) for i in range(len(text)) if text.startswith(p, i))


def occurrences(spark, texts, patterns, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    d = dictionary_from_pairs(spark, [(p, "r") for p in patterns])
    got = anchor.find_candidates(df, d, drop_shadowed=False, **kw).collect()
    assert all(r.length == len(r.text) for r in got)
    out = [[] for _ in texts]
    for r in got:
        out[r.doc_id].append((r.start, r.text))
    return [sorted(x) for x in out]


def test_hashes_of_stretches():
    r = random.Random(1)
    text = "".join(r.choice("ab\U0001f600é") for _ in range(300))
    rolling, keys = texthash.Rolling(texthash.codes(text)), texthash.Prefixes(texthash.codes(text))
    at = {}
    for n in (1, 2, 5, 100):
        grams = rolling.grams(n)
        start = np.arange(len(text) - n + 1)
        size = np.full(len(start), n)
        assert (rolling.at(start, size) == grams).all()
        for kind, values in (("grams", grams), ("keys", keys.keys(start, size))):
            for s, h in zip(start, values):
                assert at.setdefault((kind, h), text[s:s + n]) == text[s:s + n]
            assert len(set(values.tolist())) == len({text[s:s + n] for s in start})
    assert len(rolling.grams(301)) == 0


def test_windows_cover_every_place_once():
    texts = ["abc", None, "", "x" * 25, "hello", "wörld" * 3]
    for size in (4, 7, 30):
        seen = []
        for w in texthash.windows(texts, 3, size):
            row, at = w.locate(np.arange(w.own))
            for k in range(w.own):
                if w.codes[k] != texthash.SEPARATOR:
                    seen.append((int(row[k]), int(at[k]), chr(w.codes[k])))
        assert sorted(seen) == [(r, i, c) for r, t in enumerate(texts) for i, c in enumerate(t or "")]


def test_key_set_and_filter():
    r = np.random.default_rng(1)
    mine, other = r.integers(0, 1 << 63, 3000, dtype=np.uint64), r.integers(0, 1 << 63, 30000, dtype=np.uint64)
    keys = texthash.KeySet(mine)
    assert keys.has(mine).all() and not keys.has(np.setdiff1d(other, mine)).any()
    assert not texthash.KeySet(mine[:0]).has(mine).any()
    words = np.zeros(1 << 10, np.uint64)
    np.bitwise_or.at(words, mine >> np.uint64(54), texthash.Bloom.masks(mine))
    bloom = texthash.Bloom(words, mine[:0])
    assert bloom.has(mine).all() and bloom.has(other).mean() < 0.03
    assert not texthash.Bloom(words, mine[:5]).has(mine[:5]).any()


@pytest.mark.parametrize("kw", [{}, {"broadcast_rows": 0}])
def test_long_patterns_over_windows_and_segments(spark, monkeypatch, kw):
    monkeypatch.setattr(anchor, "SEGMENT", 64)
    r = random.Random(3)
    body = "".join(r.choice("abcé😀") for _ in range(3000))
    patterns = [body[100:700], body[1000:1017], body[2990:], body[5:6], body[50:66], body[50:65], "zz", body[100:700] + "!"]
    texts = [body, body[100:700], body[200:900] + body[100:700] + body[100:700], "", None, "a", body[2990:] * 3]
    want = [every(t or "", patterns) for t in texts]
    assert occurrences(spark, texts, patterns, **kw) == want


def test_a_document_of_many_windows(spark):
    r = random.Random(4)
    body = "".join(r.choice("abcd") for _ in range(2 * texthash.WINDOW + 500))
    cuts = [texthash.WINDOW - 3, texthash.WINDOW - 400, 2 * texthash.WINDOW - 30, 2 * texthash.WINDOW + 490, 0]
    patterns = [body[a:a + n] for a, n in zip(cuts, (10 + 20, 1000, 40, 10, 25))]
    got = occurrences(spark, [body], patterns)[0]
    assert {(a, body[a:a + len(p)]) for a, p in zip(cuts, patterns)} <= set(got)
    assert got == sorted((i, p) for p in set(patterns) for i in _all(body, p))


def _all(text, p):
    i = text.find(p)
    while i >= 0:
        yield i
        i = text.find(p, i + 1)


@pytest.mark.parametrize("kw", [{}, {"broadcast_rows": 0}])
def test_patterns_that_share_a_common_beginning(spark, kw):
    """Sixteen common characters at the start of every pattern make no hot key: each is found by a rarer stretch."""
    start = "the very common "
    patterns = [start + f"ending{i:04d}" for i in range(200)]
    texts = [start * 50 + patterns[i] for i in range(0, 200, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    d = dictionary_from_pairs(spark, [(p, "r") for p in patterns])
    anchors = anchor._anchors(df, "text", d, 16, None, True)
    assert anchors.groupBy("h").count().agg({"count": "max"}).first()[0] < anchor.SHARED_BY
    assert anchors.where("o = 0").count() == 0
    assert occurrences(spark, texts, patterns, **kw) == [every(t, patterns) for t in texts]


def test_thue_morse_texts(spark):
    """Texts whose hashes modulo 2**64 agree although they differ are told apart by their text."""
    t = "a"
    for _ in range(12):
        t += t.translate({97: 98, 98: 97})
    other = t.translate({97: 98, 98: 97})
    one, two = texthash.codes(t), texthash.codes(other)
    assert texthash.Rolling(one).grams(len(t))[0] == texthash.Rolling(two).grams(len(t))[0]
    size, zero = np.array([len(t)]), np.zeros(1, np.int64)
    assert texthash.Prefixes(one).keys(zero, size) != texthash.Prefixes(two).keys(zero, size)
    for kw in ({}, {"broadcast_rows": 0}):
        assert occurrences(spark, [t, other], [t], **kw) == [[(0, t)], []]


@pytest.mark.parametrize("block", [2, 5, 16, 4096])
def test_chains_of_overlapping_candidates(spark, block):
    r = random.Random(block)
    dictionaries = [["aa"], ["aba", "bab"], ["aab", "abaab", "ba"], ["a" * 7, "b"], ["ab", "bc", "ca"]]
    for patterns in dictionaries:
        texts = ["a" * 101, "ab" * 60, "", None, "abc" * 40]
        texts += ["".join(r.choice("aab") for _ in range(r.randint(1, 120))) for _ in range(20)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
        d = dictionary_from_pairs(spark, [(p, "r") for p in patterns])
        found = anchor.find_candidates(df, d, row_id=True)
        got = sorted((x.doc_id, x.ordinal, x.start, x.text) for x in anchor.resolve_overlaps(found, block=block).collect())
        want = [(i, k, s, p) for i, t in enumerate(texts) for k, (s, p) in enumerate(retry(t or "", patterns))]
        assert got == sorted(want), patterns


def test_a_chain_through_a_whole_document_is_spread(spark):
    n = 200_001
    df = spark.createDataFrame([(1, "a" * n)], "doc_id INT, text STRING")
    got = anchor.find_all_anchor(df, dictionary_from_pairs(spark, [("aa", "r")]))
    row = got.selectExpr("count(*)", "sum(start)", "max(ordinal)", "count(distinct start % 2)").first()
    assert tuple(row) == (n // 2, (n // 2) * (n // 2 - 1), n // 2 - 1, 1)
