"""The walk for any dictionary against the plain walk."""

import random

import numpy as np
import pytest
from brute import walk

from multimatch.functions import texthash
from multimatch.operators import walk as any_walk
from multimatch.operators.dictionary import compile_dictionary, dictionary_from_pairs
from multimatch.operators.search import find_all


def compare(spark, texts, patterns, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    d = dictionary_from_pairs(spark, [(p, f"r{i}") for i, p in enumerate(patterns)])
    got = sorted((r.doc_id, r.ordinal, r.start, r.text) for r in any_walk.find_all_walk(df, d, **kw).collect())
    want = [(i, k, s, p) for i, t in enumerate(texts) for k, (s, p) in enumerate(walk(t or "", patterns))]
    assert got == sorted(want)


def test_chain_of_places():
    r = random.Random(1)
    for n in (0, 1, 5, 300):
        for block in (2, 7, 512):
            after = np.array([i + r.choice([1, 1, 2, 9, 40]) for i in range(n)], np.int64)
            at, want = 0, []
            while at < n:
                want.append(at)
                at = int(after[at])
            path, end = any_walk.visited(after, 0, block)
            assert path.tolist() == want and end == at


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk_equals_the_plain_one(spark, monkeypatch, seed):
    r = random.Random(seed)
    patterns = list({"".join(r.choice("abcé") for _ in range(r.randint(1, 9))) for _ in range(40)})
    texts = ["".join(r.choice("abcé😀") for _ in range(r.randint(0, 400))) for _ in range(40)] + [None, "", "a"]
    compare(spark, texts, patterns)
    monkeypatch.setattr(texthash, "WINDOW", 50)
    monkeypatch.setattr(any_walk, "windows", lambda t, ahead: texthash.windows(t, ahead, 37))
    compare(spark, texts, patterns)


def test_filters_that_say_yes_too_often_are_corrected(spark, monkeypatch):
    r = random.Random(7)
    patterns = list({"".join(r.choice("ab") for _ in range(r.randint(6, 14))) for _ in range(60)})
    texts = ["".join(r.choice("ab") for _ in range(500)) for _ in range(30)]

    def full(keys, n):  # three bits in four are set
        return np.random.default_rng(n).integers(0, 1 << 63, 1 << 10, dtype=np.uint64) | words(keys, n) | np.uint64(
            0x7777777777777777)

    words = any_walk.bloom_words
    monkeypatch.setattr(any_walk, "bloom_words", full)
    compare(spark, texts, patterns, node_limit=0)


def test_many_patterns_and_a_long_one(spark):
    r = random.Random(5)
    long_one = "".join(r.choice("abcdefgh ") for _ in range(10_000))
    patterns = list({"".join(r.choice("abcdefgh") for _ in range(r.randint(4, 12))) for _ in range(50_000)}) + [long_one]
    patterns = [p for p in patterns if p == long_one or not long_one.startswith(p)]  # it is not shadowed
    texts = [" " + long_one + " " + long_one[:9_999] + "!" + long_one]
    texts += ["".join(r.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)]
    compare(spark, texts, patterns)


def test_walk_routes_agree(spark):
    rows = [(1, "abc x  \nabcde cde"), (1, "cde"), (None, "abcabc  ab"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id INT, text STRING")
    d = dictionary_from_pairs(spark, [("abc", "1"), ("cde", "22"), ("ab", "3"), ("x", ""), ("cde", "9"), ("", "e")])
    want = sorted(map(str, find_all(df, compile_dictionary(d), mode="walk").collect()))
    for kw in ({}, {"node_limit": 0}):
        got = any_walk.find_all_walk(df, d, **kw)
        assert sorted(map(str, got.collect())) == want
    assert any_walk.find_all_walk(df, d.limit(0)).count() == 0
