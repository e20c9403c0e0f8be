"""The pipeline against the stages done one by one in plain Python."""

import corpus_pipeline
import plain
import sentencepiece
from pyspark.sql import functions as F

from multimatch.llm import langid, pieces

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    names = docs.columns
    # language ID: the learned filters, applied here text by text
    filters = langid.learn_from(docs)
    lang, score = filters.predict([r["text"] for r in rows])
    rows = [r for r, x, s in zip(rows, lang, score) if x != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    # near-duplicates: the smallest id of each group
    _, component, _ = plain.simhash_components([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r, c in zip(rows, component) if r["doc_id"] == c]
    # repeated passages
    left = []
    for r, (w, n, kept) in zip(rows, plain.repeats([(r["doc_id"], r["text"]) for r in rows])):
        if n and not kept:
            continue
        text = b" ".join(kept).decode() if n else r["text"]
        left.append({**r, "text": text, "n_chars": len(text) if n else r["n_chars"]})
    # benchmark overlaps
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in plain.leaks([(r["doc_id"], r["text"]) for r in left], items)}
    left = [r for r in left if r["doc_id"] not in bad]
    assert 0 < len(left) < docs.count()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*names, "ids", "n_ids", "round_trip"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in left)
    for r in left:
        g = got[r["doc_id"]]
        assert {k: g[k] for k in names} == r
        assert g["ids"] == library.encode(r["text"]) and g["n_ids"] == len(g["ids"]) and g["round_trip"]


def test_stages_take_odd_tables(spark):
    odd = [(1, None, "en", "a", None), (None, "the cat and the dog", None, None, 3), (2, "", "en", "a", 0),
           (3, "the cat and the dog", "en", "b", 19), (3, "the cat and the dog", "en", "b", 19), (4, "word " * 30_000, "en", "c", 9)]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {"language ID": [None, 3, 3, 4], "SimHash near-dedup": [1, 3, 4], "substring dedup": [None, 1, 2, 3, 3, 4],
            "benchmark decontamination": [None, 1, 2, 3, 3, 4], "SentencePiece encoding and decoding": [None, 1, 2, 3, 3, 4]}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.where("doc_id > 99"), SF)
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns == empty.columns, name
        assert empty.count() == 0, name
        got = out.collect()
        assert sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0)) == want[name], name
        assert {(r["doc_id"], r["text"]) for r in got} <= {(i, t) for i, t, *_ in odd}, name
    clash = docs.withColumn("ids", F.lit("x")).withColumn("n_ids", F.lit(7)).withColumn("round_trip", F.lit(1))
    last = corpus_pipeline.pieces_stage(spark, clash, SF)
    assert last.columns == [*docs.columns, "ids", "n_ids", "round_trip"]
    assert {(len(r["ids"]), r["n_ids"], r["round_trip"]) for r in last.where("doc_id IN (1, 2)").collect()} == {(0, 0, True)}


def test_documents_stay_if_no_language_is_learned(spark):
    rows = [(1, "the cat", None), (2, "12 34", None), (3, None, None), (4, "\n漢字", None), (4, "\n漢字", None), (None, "é", None)]
    docs = spark.createDataFrame([(i, t, x, "a", 1) for i, t, x in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.language_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r["text"] for r in out.collect()) == sorted(["the cat", "\n漢字", "\n漢字", "é"])
