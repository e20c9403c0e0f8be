"""The findings of round 4: small cases that failed before, one by one."""

import os

from multimatch.session import shared_dir
from multimatch.sources import corpus


def _made(files):
    for path, content in files.items():
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)


def _rows(df):
    return sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in df.collect())


def test_files_below_folders_are_not_kept_by_the_driver(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BATCH_FILES", 3, raising=False)
    monkeypatch.setattr(corpus, "BATCH_BYTES", 1000, raising=False)
    root = shared_dir(spark, "folders").removeprefix("file:")
    names = [f"{i % 7}/{i}.txt" for i in range(150)]
    names += ["_made=1/a", "_made/a", "x/.made/a", "_metadata/a", "x/_metadata", "x/_a", "x/_k=a", "x/.a",
              "x/a._COPYING_", "x/deep/er/é %20#+&?*.txt", "a b/doc_id=-1.0.txt", "big/1", "big/2"]
    _made({f"{root}/{n}": b"\xff\x00\n" * (i % 5) for i, n in enumerate(names)}
          | {f"{root}/big/1": b"x" * 5_000, f"{root}/big/2": b"y" * 5_000, f"{root}/empty": b""})
    os.symlink(f"{root}/big", f"{root}/link")
    os.symlink(f"{root}/nothing", f"{root}/lost")
    for paths in (root, f"file://{root}/", [f"{root}/big", f"file:{root}/x/", f"{root}//x/deep", f"{root}/big"]):
        got = corpus.read_files(spark, paths, recursive=True)
        was = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
            paths if isinstance(paths, str) else list(paths))
        assert got.dtypes == was.dtypes
        assert _rows(got) == _rows(was)
        assert not got.inputFiles()  # before: a name for each file, and a task for every few of them
        assert got.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)
    assert len(_rows(corpus.read_files(spark, root, recursive=True))) > 100


def test_other_paths_keep_sparks_reader(spark):
    root = shared_dir(spark, "folders").removeprefix("file:")
    _made({f"{root}/a/1.txt": b"1", f"{root}/a/2.log": b"2", f"{root}/b/3.txt": b"3"})
    read = lambda *a, **k: sorted(bytes(r.content) for r in corpus.read_files(spark, *a, recursive=True, **k).collect())
    assert read(root, glob="*.txt") == [b"1", b"3"]
    assert read(f"{root}/[a]") == [b"1", b"2"]
    assert read([f"{root}/a/1.txt", f"{root}/b"]) == [b"1", b"3"]
    try:
        read(f"{root}/c")
        raise AssertionError("a path that is not there was read")
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e)


def test_corpus_scan_has_a_row_per_document_and_no_file_list(spark):
    import __spark_entry__ as e
    texts = ["", None, "a\nb", "é\U0001F600", "x" * 100_000, "same", "same"] * 40
    keys = [None if i % 50 == 7 else i // 2 - 3 for i in range(len(texts))]
    sf = shared_dir(spark, "sf")
    spark.createDataFrame(list(zip(keys, texts)), "doc_id BIGINT, text STRING").write.parquet(f"{sf}/documents.parquet")
    out = e.queries()["corpus_scan"](spark, sf)
    want = [(k, len((t or "").encode()) + 1, len(t or "") + 1) for k, t in zip(keys, texts)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out.collect()), key=order) == sorted(want, key=order)
    assert not out.inputFiles()  # before: one for each document, in the driver's memory
