"""Token files, whitening and tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from multimatch.llm import alignment, simple8b, tokenbin, whitening, wordids
from multimatch.session import shared_dir

BPE, PIECES = tokenbin.DEFAULT_FILE, alignment.DEFAULT_MODEL
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "  lead", "tail  ", "x\n", "x\n y", "tabs\tand  spaces \n \n end",
       "don't we'll I'd", "naïve Ünïcode straße", "日本語 のテキスト", "😀 emoji 👩‍👩‍👧", "é combining", " nbsp  x", "a b   c",
       "<|endoftext|>", "before <|endoftext|> after<|endoftext|>", "</s><s> <unk> [INST]", "▁ low ▁line a▁ b", "\x00null\x1fctl \x85 x",
       "﻿bom", "​zero width​ x", "12345 6,789.00 $%^", "w" * 300, "पठन हिन्दी में", "عربى نص", "<0x0A>", "\r\n\r\n", "'s 's x's"]


def texts(seed=1, n=120):
    r = random.Random(seed)
    words = ["the", "Lorem", "ipsum,", "don't", "über", "naïve.", "\n", "", "x\ny", "日本", "12", "***", "é", "a b", "<|endoftext|>", "▁"]
    words += ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 12))) for _ in range(60)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return ODD + out + out[:5] + [" ".join(words) * 900]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(BPE)
    return t, sentencepiece.SentencePieceProcessor(model_file=PIECES)


# ---- Simple-8b ---------------------------------------------------------------

def test_packed_arrays_come_back():
    r = np.random.default_rng(1)
    for trial in range(200):
        n, bits = int(r.integers(0, 2500)), int(r.integers(0, 65))
        v = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
        v = v >> np.uint64(64 - bits) if bits else v * np.uint64(0)
        if trial % 2:  # of all sizes, numbers of more than 60 bits too
            v = v >> r.integers(0, 64, n).astype(np.uint64)
        p = simple8b.Packed(simple8b.pack(v))
        assert np.array_equal(p.decode(), v) and p.n == n
        a, z = sorted(r.integers(0, n + 1, 2).tolist())
        assert np.array_equal(p.decode(a, z), v[a:z])
        # every word holds as many as fit: one more would not
        assert len(p.words) <= n
    assert len(simple8b.pack(np.zeros(512, np.uint64))) < 200
    with pytest.raises(ValueError):
        simple8b.Packed(b"something else")


def test_words_take_the_most_numbers_that_fit():
    v = np.array([1, 0] * 30 + [5] * 20 + [(1 << 60) - 1, 1 << 60, 7], np.uint64)
    p = simple8b.Packed(simple8b.pack(v))
    assert [int(w >> np.uint64(60)) for w in p.words] == [2, 4, 15, 0, 4]  # what a block lacks at its end is zeros
    assert p.escaped.tolist() == [1 << 60] and np.array_equal(p.decode(), v)


# ---- words -------------------------------------------------------------------

@pytest.mark.parametrize("plain", [False, True])
def test_words_equal_whole_texts(library, plain):
    file = open(BPE, encoding="utf-8").read()
    bpe, pieces = wordids.ByteBpe(file, plain), wordids.Pieces(open(PIECES, "rb").read())
    t = tokenizers.Tokenizer.from_file(BPE)
    t.encode_special_tokens = plain
    some = [x or "" for x in texts()]
    raw = [x.encode() for x in some]
    one, lead = wordids.Words([bpe], lead=False), wordids.Words([bpe, pieces], lead=True, check=True)
    for _ in range(2):  # the second time from memory
        for part in (slice(0, 50), slice(50, None)):
            ((ids, n),), _ = one.encode(raw[part])
            got = np.split(ids, np.cumsum(n)[:-1])
            for x, g in zip(some[part], got):
                assert g.tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
            both, spelt = lead.encode(raw[part])
            for k, want in enumerate((lambda x: t.encode(" " + x, add_special_tokens=False).ids, library[1].encode)):
                got = np.split(both[k][0], np.cumsum(both[k][1])[:-1])
                for x, g in zip(some[part], got):
                    assert not x or g.tolist() == list(want(x)), repr(x)
    bpe.apart = pieces.apart = False  # files that promise nothing: whole texts
    whole = wordids.Words([bpe, pieces], lead=True, check=True)
    (a, b), ok = whole.encode(raw)
    (c, d), fine = lead.encode(raw)
    empty = np.array([x == b"" for x in raw])
    keep = np.repeat(~empty, a[1])
    assert np.array_equal(a[0][keep], c[0][np.repeat(~empty, c[1])]) and np.array_equal(ok[~empty], fine[~empty])


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(wordids, "REMEMBERED", 20)
    bpe = wordids.ByteBpe(open(BPE, encoding="utf-8").read(), False)
    words = wordids.Words([bpe], lead=False)
    for x in texts(4, 30):
        ((ids, _),), _ = words.encode([(x or "").encode()])
        assert ids.tolist() == bpe.library.encode(x or "", add_special_tokens=False).ids


# ---- token files -------------------------------------------------------------

def test_token_files(spark, library):
    r = random.Random(3)
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "null id"), (None, None), (7, "seven again"), (-5, "first")]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows],
                                 "doc_id bigint, text string, start int, ids string, n_tokens int").repartition(5)
    path = tokenbin.write_ids(docs, shared_dir(spark, "ids"))
    got = sorted(tokenbin.read_documents(spark, path).collect(), key=lambda x: x["start"])
    assert len(order) == len(got)
    ids_of = lambda t: library[0].encode(t or "", add_special_tokens=False).ids + [2]
    assert Counter((x["id"], tuple(x["tokens"])) for x in got) == Counter((i, tuple(ids_of(t))) for i, t in rows)
    start, last = 0, None
    for x in got:
        raw = np.array(x["tokens"], "<u4").tobytes()
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(x["tokens"]), zlib.crc32(raw))
        assert last is None or (x["id"] is not None and x["id"] >= last)
        start, last = start + len(x["tokens"]), x["id"]
    index = tokenbin.document_index(spark, path)
    assert Counter(map(tuple, index.collect())) == Counter((x["id"], x["start"], x["n_tokens"]) for x in got)
    every = [t for x in got for t in x["tokens"]]
    for a, z in ((0, 10), (5, start), (start - 3, start + 10), (700, 701), (9, 9)):
        part = sorted(tokenbin.read_range(spark, path, a, z).collect(), key=lambda x: x["start"])
        assert [t for x in part for t in x["tokens"]] == every[a:z]
        assert not part or part[0]["start"] == a


def test_token_files_of_empty_tables_and_broken_texts(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    path = tokenbin.write_ids(docs, shared_dir(spark, "ids"))
    assert tokenbin.read_documents(spark, path).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    got = tokenbin.read_documents(spark, tokenbin.write_ids(broken, shared_dir(spark, "ids"))).collect()
    assert got[0]["tokens"] == tokenizers.Tokenizer.from_file(BPE).encode("a�b").ids + [2]


# ---- whitening ---------------------------------------------------------------

def exact(rows):
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(v[d] for v in x) for d in range(dim)]
    cov = np.array([[(n * sum(v[i] * v[j] for v in x) - s[i] * s[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    return x, s, cov


def test_scatter_is_exact():
    r = np.random.default_rng(1)
    for bits in (1, 5, 17, 40, 62):
        y = r.integers(0, 1 << bits, (130, 5))
        y[:, 2] = 0
        scatter = whitening.Scatter(np.array([int(v).bit_length() for v in y.max(0)]))
        for part in np.array_split(y, 3):
            scatter.add(part)
        got = scatter.batch().to_pydict()
        value = {(i, j): sum(got[f"l{k}"][n] << 32 * k for k in range(whitening.LIMBS))
                 for n, (i, j) in enumerate(zip(got["i"], got["j"]))}
        big = y.astype(object)
        for i in range(5):
            assert value[i, -1] == sum(big[:, i])
            for j in range(i, 5):
                assert value[i, j] == sum(big[:, i] * big[:, j])


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e9])
def test_whitening(spark, scale):
    r = np.random.default_rng(2)
    base = (r.normal(size=(150, 12)) @ r.normal(size=(12, 12)) * scale).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(3, base[3].tolist()), (None, base[0].tolist())]
    odd = [(900, None), (901, [float("nan")] * 12), (902, [float("inf")] + [0.0] * 11), (903, [None] + [0.0] * 11),
           (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows + odd], "vec_id bigint, embedding array<float>, n string, component int")
    got = whitening.whiten(df).collect()
    x, s, cov = exact([np.array(v, np.float32).astype(float) for _, v in rows])
    n = len(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (np.array([[n * a - b for a, b in zip(v, s)] for v in x], object).astype(float) / n) @ vectors[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and {g["n"] for g in got} == {n} and {g["component"] for g in got} == set(range(1, 9))
    by_id = {}
    for g in got:
        by_id.setdefault(g["id"], {}).setdefault(g["component"], []).append(g)
    sign = [1 if by_id[0][c + 1][0]["whitened"] * want[0][c] > 0 else -1 for c in range(8)]
    for k, (i, _) in enumerate(rows):
        for c in range(8):
            mine = by_id[i][c + 1]
            assert len(mine) == (2 if i == 3 else 1)
            assert mine[0]["whitened"] == pytest.approx(sign[c] * want[k][c], abs=1e-8)
            assert int(mine[0]["deviation"]) == sum((n * a - b) ** 2 for a, b in zip(x[k], s))
            assert mine[0]["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
            assert mine[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # no variance
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0]) for k in range(5)], schema)  # one direction
    got = whitening.whiten(flat).collect()
    assert {g["component"] for g in got} == {1} and got[0]["explained"] == pytest.approx(1)
    assert sum(g["whitened"] ** 2 for g in got) / 5 == pytest.approx(1)


# ---- alignment ---------------------------------------------------------------

def test_merge_by_pieces():
    r = random.Random(5)
    for _ in range(200):
        total = r.randint(1, 300)
        cuts = lambda: np.array(sorted({total, *r.sample(range(1, total + 1), r.randint(0, total))}))
        a, b = cuts(), cuts()
        at_a, at_b, of_b, overlap, group = alignment.merge_pieces(a, b, r.choice([1, 3, 64]))
        merged = sorted([(e, 0, k) for k, e in enumerate(a)] + [(e, 1, k) for k, e in enumerate(b)])
        assert [(int(j if o else i), int(o)) for i, j, o in zip(at_a, at_b, of_b)] == [(k, side) for _, side, k in merged]
        links = {(int(i), int(j)) for i, j, o in zip(at_a, at_b, overlap) if o}
        begin = lambda x, k: x[k - 1] if k else 0
        assert links == {(i, j) for i in range(len(a)) for j in range(len(b)) if begin(a, i) < b[j] and begin(b, j) < a[i]}
        both = sorted(set(a) & set(b))
        assert group.tolist() == [int(np.searchsorted(both, e)) for e, _, _ in merged]
    for x in alignment.merge_pieces(np.zeros(0, np.int64), np.zeros(0, np.int64)):
        assert len(x) == 0


def aligned(text, library):
    """Groups and links of one text by two pointers."""
    t, sp = library
    stands = wordids.byte_of_char()
    if not text:
        return None
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    spell_a = [bytes(stands[c] for c in t.id_to_token(x)) for x in a]
    spell_b = [bytes([int(sp.id_to_piece(x)[1:-1], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
    want = (" " + text).encode()
    if b"".join(spell_a) != want or b"".join(spell_b) != want:
        return None
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in (spell_a, spell_b)]
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
             if max(ends[0][i] - len(spell_a[i]), ends[1][j] - len(spell_b[j])) < min(ends[0][i], ends[1][j])] if len(a) < 400 else None
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        i, j = p, q
    return len(a), len(b), groups, links


@pytest.mark.parametrize("shared", [alignment.SHARED, 40, 0])
def test_alignment(spark, library, shared):
    t = tokenizers.Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    rows = [(k, x) for k, x in enumerate(texts(2, 60)[:-1])] + [(None, "the Lorem"), (3, "again three")]
    docs = spark.createDataFrame([(i, x, 5, "g") for i, x in rows], "doc_id bigint, text string, n_a int, row string").repartition(4)
    got = {}
    for x in alignment.corpus_links(docs, shared=shared).collect():
        got.setdefault(x["id"], []).append(tuple(x)[1:])
    count, want = Counter(), {}
    each = [(i, aligned(x, (t, library[1]))) for i, x in rows]
    for _, x in each:
        if x:
            count.update(x[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for i, x in each:
        row = (0, 0, 0, 0, "", 0, 0) if x is None else (
            x[0], x[1], len(x[2]), len(x[3]), ";".join(x[2]), sum(count[p] == best[p[1]] for p in x[3]), sum(count[p] for p in x[3]))
        want.setdefault(i, []).append(row)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert any(x is None for _, x in each) and sum(x is not None for _, x in each) > 60


def test_alignment_of_long_texts_and_odd_tables(spark, library):
    t = tokenizers.Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    text = texts(3, 40)[-1].replace("▁", "")
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    got = {x["id"]: x for x in alignment.corpus_links(docs, digest=True).collect()}
    a, b, groups, _ = aligned(text, (t, library[1]))
    assert (got[1]["n_a"], got[1]["n_b"], got[1]["n_groups"]) == (a, b, len(groups))
    assert got[1]["n_links"] == a + b - len(groups)
    assert got[1]["groups"] == hashlib.sha256(";".join(groups).encode()).hexdigest() and got[2]["groups"] == ""
    assert alignment.corpus_links(docs.where(F.lit(False))).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert alignment.corpus_links(broken).first()["n_a"] == 0
