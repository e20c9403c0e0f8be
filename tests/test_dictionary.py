"""Dictionary loading, ids, lint, prefix table, regex dialect."""

import pytest
from pyspark.sql import functions as F

from multimatch.functions.regex import RegexDialectError, translate_pattern
from multimatch.operators import dictionary as dic
from multimatch.plans import fixtures
from multimatch.session import shared_dir
from multimatch.sources import dictionary_file as dict_file


def write_file(spark, text, name="p"):
    path = shared_dir(spark, name)
    import os
    os.makedirs(path)
    with open(f"{path}/patterns.txt", "w", encoding="utf-8") as f:
        f.write(text)
    return path


# FIXTURES.md D4: line -> expected (pattern, replacement) or reject reason
D4 = [
    ('"a" "b"', ("a", "b")),
    ('note "a b" => "c" tail', ("a b", "c")),
    ('"a""b"', "no separator"),
    ('"a"', "no replacement"),
    ('"a" ""', "empty replacement"),
    ('"" "b"', "empty pattern"),
    ('"a" "" "b"', ("a", '" ')),
    ("no marks", "no marks"),
]


def test_loader_lines(spark):
    path = write_file(spark, "\n".join(l for l, _ in D4))
    good = {r.line_no: (r.pattern, r.replacement) for r in dict_file.load_dictionary(spark, path).collect()}
    bad = {r.line_no: r.reason for r in dict_file.dictionary_rejects_file(spark, path).collect()}
    for i, (_, want) in enumerate(D4):
        if isinstance(want, tuple):
            assert good[i] == want
        else:
            assert bad[i] == want


def test_loader_grouping_and_empty_line(spark):
    path = write_file(spark, "'a' 'b'\n\n'x' 'y'")
    rows = dict_file.load_dictionary(spark, path, grouping="'").collect()
    assert [(r.line_no, r.pattern, r.replacement) for r in rows] == [(0, "a", "b")]


def test_manual_fixture_dictionary(spark):
    path = write_file(spark, fixtures.SAMPLE_PATTERN_FILE)
    rows = sorted(dict_file.load_dictionary(spark, path).collect())
    assert [tuple(r) for r in rows] == [(0, "test one", "replace one", 0),
                                        (1, "test two", "two replace", 1),
                                        (2, "abcdefg", "hijklmnop", 2)]
    nodes = dic.prefix_nodes(dict_file.load_dictionary(spark, path))
    assert nodes.where(F.col("depth") > 0).count() == 18  # plus the root row
    br = {r.prefix: r.breadth for r in dic.node_breadth(nodes).collect()}
    assert br[""] == 2 and br["test "] == 2
    assert all(b == 1 for p, b in br.items() if p not in ("", "test ") and
               p not in ("test one", "test two", "abcdefg"))


def test_ids_lint_shadowing(spark):
    d = dic.dictionary_from_pairs(spark, fixtures.D1)
    ids = {r.line_no: r.replacement_id for r in d.collect()}
    assert ids[9] == ids[2] == 2 and ids[10] == 9 and ids[11] == 10
    lint = {(r.line_no, r.issue): r.detail for r in dic.dictionary_lint(d).collect()}
    assert lint == {(8, "duplicate"): "of line 0, other replacement", (7, "shadowed"): "by ou"}
    act = {r.pattern for r in dic.active_dictionary(d).collect()}
    assert "oué" not in act and "ou" in act and len(act) == 10


def test_saved_round_trip(spark):
    d = dic.dictionary_from_pairs(spark, fixtures.D1)
    path = shared_dir(spark, "saved")
    dict_file.save_dictionary(d, path)
    assert sorted(dict_file.read_saved_dictionary(spark, path).collect()) == sorted(d.collect())


@pytest.mark.parametrize("src,want", [
    ("[0-9]+%", "[0-9]+?\\x{25}"),
    ("L.cense", "L(?s:.)cense"),
    ("h[a-c]+n", "h[a-c]+?n"),
    ("\\.x*", "\\x{2e}x*?"),
    ("a]b", "a\\x{5d}b"),
    ("[^a[]", "[^a\\x{5b}]"),
    ("(ab)+", "(?:ab)+?"),
])
def test_regex_dialect(src, want):
    assert translate_pattern(src) == want


@pytest.mark.parametrize("src", ["^a", "+a", "(a", "a)", "[a", "[b-a]", "\\"])
def test_regex_dialect_rejects(src):
    with pytest.raises(RegexDialectError):
        translate_pattern(src)


def test_distributed_ids_equal_driver_ids(spark):
    rows = [(i, p, r) for i, (p, r) in enumerate(fixtures.D1)]
    df = spark.createDataFrame(rows, "line_no INT, pattern STRING, replacement STRING")
    a = sorted(map(tuple, dic.assign_replacement_ids(df).collect()))
    b = sorted(map(tuple, dic.dictionary_from_pairs(spark, fixtures.D1).collect()))
    assert a == b


def test_branching_nodes_and_their_ids(spark):
    import random
    r = random.Random(3)
    words = ["".join(r.choice("abé😀") for _ in range(r.randint(1, 7))) for _ in range(150)] + ["abc" * 20, "abc" * 20 + "d", "x"]
    for few in (words, ["one"], ["a", "ab"]):
        d = dic.dictionary_from_pairs(spark, [(w, f"r{i % 40}") for i, w in enumerate(few)] + [("", "e")])
        own = {x.line_no: x.pattern for x in dic.sorted_patterns(d).collect()}
        assert sorted(own.values()) == sorted(set(few))
        nodes = dic.branching_nodes(d)
        kids = {}
        for w in set(few):
            for i in range(len(w) + 1):
                kids.setdefault(w[:i], set()).add(w[i:i + 1])
        want = {p for p, k in kids.items() if len(k) > 1} | {""}
        got = {x.node: own[x.line_no][:x.depth] for x in nodes.collect()}
        assert set(got.values()) == want and len(got) == len(want)
        ids = {}
        for x in dic.node_ids(d, nodes).collect():
            bits = int.from_bytes(bytes(x.ids), "little")
            here = {k for k in range(bits.bit_length()) if bits >> k & 1}  # bucket 0 has id 0, bucket 1 the ids from 1
            ids.setdefault(got[x.node], set()).update({0} if x.bucket == 0 else {(x.bucket - 1) * 32768 + k + 1 for k in here})
        rid = {x.pattern: set() for x in d.collect()}
        for x in d.collect():
            rid[x.pattern].add(x.replacement_id)
        assert ids == {p: set().union(*[v for w, v in rid.items() if w and w.startswith(p)]) for p in want}
