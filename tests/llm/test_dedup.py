"""Near-duplicates (vectors, fingerprints) and repeated passages against brute force."""

import math
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from multimatch.llm import metricjoin, repeats, simhash
from multimatch.llm.common import connected_components
from multimatch.llm.fmindex import FMIndex

TEXT = "doc_id bigint, text string, id string, fp string, words int, starts int, kept string"


def texts(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "Ünï", "😀"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 90))) for _ in range(25)]
    shared = " ".join(r.choice(vocabulary) for _ in range(30))
    out = []
    for i, t in enumerate(base):
        out.append((i, t if i % 3 else t + " " + shared + " tail " + str(i)))
        if i % 4 == 0:
            out.append((100 + i, t))
            out.append((200 + i, (t + " x").replace("w1 ", "W1\t")))
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (None, base[3]), (None, None), (5, base[5]),
            (5, "another text of id five " + shared), (304, "long " * 4000 + shared), (305, base[7])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z") for i, t in rows], TEXT)


def test_fingerprint_is_the_majority_of_the_shingle_hashes():
    for _, t in texts():
        assert simhash.fingerprint(t.encode() if t is not None else None, 4) & (2 ** 64 - 1) == plain.simhash(t)


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = texts()
    fp, want, root = plain.simhash_components(rows)
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    key = lambda x: str(x)
    assert sorted([(r["id"], r["fp"] & (2 ** 64 - 1), r["component_id"]) for r in got], key=key) == \
        sorted([(i, f, c) for (i, _), f, c in zip(rows, fp, want)], key=key)
    kept = simhash.simhash_dedup(frame(spark, rows))
    assert kept.columns == TEXT.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    assert kept.count() == len(set(root))
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids - {None} == {c for c in want if c is not None} or ids >= {c for c in want if c is not None}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(70)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 3)]
    e = spark.createDataFrame(chain, "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{1000 + i: 1000 for i in range(60)}}
    assert connected_components(e.where("u < 0")).count() == 0


def test_backward_search_counts_occurrences():
    r = np.random.default_rng(3)
    text = np.concatenate([np.append(r.integers(1, 6, 40), 0) for _ in range(12)])
    index = FMIndex(text, 5)
    body = text.tolist()
    ends = np.array([i for i in range(4, len(text)) if 0 not in body[i - 4:i + 1]])
    lo, hi, size = index.matches(text, ends, 5)
    for e, a, b, n in zip(ends.tolist(), lo, hi, size):
        p = body[e - 4:e + 1]
        assert n == 5 and b - a == sum(body[k:k + 5] == p for k in range(len(body)))


@pytest.mark.parametrize("hot,shard", [(20_000, 1_000_000), (2, 1_000_000), (1, 50)])
def test_remove_repeats(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD_WORDS", shard)
    rows = texts(4)
    want = sorted((str(i), len(w), n, b" ".join(k).decode()) for (i, _), (w, n, k) in zip(rows, plain.repeats(rows)))
    out = repeats.remove_repeats(frame(spark, rows))
    got = sorted((str(r["doc_id"]), r["__n_words"], r["__n_removed"], r["__kept"]) for r in out.collect())
    assert got == want and sum(x[2] for x in want) > 100


def test_word_hashes_differ():
    h, start = repeats.word_hashes(np.frombuffer(b"the cat  the\tdog cat", np.uint8))
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3 and start.tolist() == [0, 4, 9, 13, 17]


def vectors(n=120, dim=8, seed=5):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, [float(x) for x in base[i % 9] + r.normal(size=dim) * 0.12]) for i in range(60)]
    rows += [(2000, rows[0][1]), (2000, rows[0][1]), (2001, [2 * x for x in rows[1][1]]), (None, rows[2][1]),
             (2002, None), (2003, []), (2004, [0.0] * dim), (2005, [math.nan] * dim), (2006, [None] + [1.0] * (dim - 1)),
             (2007, [math.inf] + [1.0] * (dim - 1)), (2008, rows[3][1] + [0.5]), (2009, [x * 1e-200 for x in rows[4][1]])]
    return rows


@pytest.mark.parametrize("cell,block,tile", [(8192, 16384, 1 << 21), (10, 7, 50)])
def test_metric_links(spark, monkeypatch, cell, block, tile):
    for k, v in (("CELL", cell), ("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(metricjoin, k, v)
    rows = vectors()
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        u = np.array(v) / np.abs(v).max() if ok else None
        unit.append(u / np.linalg.norm(u) if ok else None)
    linked = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and \
        float(unit[i] @ unit[j]) >= 0.9
    n = len(rows)
    root = plain.components(n, linked)
    low = {}
    for (i, _), x in zip(rows, root):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    want = sorted(str((i, sum(linked(a, b) for b in range(n) if b != a), low.get(root[a])))
                  for a, (i, _) in enumerate(rows))
    df = spark.createDataFrame([(i, v, "a", "b", 3) for i, v in rows],
                               "vec_id bigint, embedding array<double>, node string, vec string, n int")
    got = sorted(str((r["id"], r["n_links"], r["component_id"])) for r in metricjoin.metric_links(df).collect())
    assert got == want


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("doc_id > 1")
    assert simhash.simhash_dedup(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    v = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    assert metricjoin.metric_links(v.where("vec_id > 1")).count() == 0
    assert metricjoin.metric_links(v.withColumn("embedding", F.lit(None).cast("array<float>"))).first()["n_links"] == 0
