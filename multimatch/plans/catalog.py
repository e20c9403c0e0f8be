"""Registered queries: one per operator of the survey, over the given tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame. Fixed
dictionaries (D1, D3) are parameters; every corpus is a table under
``sf_dir`` (or data Spark derives from one), read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchor
from ..operators import dictionary as dic
from ..operators import large, report, rewrite, search, walk
from ..session import shared_dir
from ..sources import corpus, sinks
from ..sources import dictionary_file as dict_file
from ..sources.corpus import read_table
from ..streaming import incremental
from . import fixtures, strategy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_COMPILED: dict[tuple, dic.CompiledDictionary] = {}


def query(name: str):
    def reg(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return reg


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", list(cols))


def d1_frame(spark: SparkSession) -> DataFrame:
    return dic.dictionary_from_pairs(spark, fixtures.D1)


def _session_key(spark: SparkSession) -> tuple:
    return (id(spark), spark.sparkContext.applicationId)


def compiled_d1(spark: SparkSession) -> dic.CompiledDictionary:
    """D1, compiled once per session (it is a fixed parameter)."""
    key = ("D1", *_session_key(spark))
    if key not in _COMPILED:
        _COMPILED[key] = dic.compile_dictionary(d1_frame(spark))
    return _COMPILED[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


# ---- M1, M2: find all ------------------------------------------------------

@query("find_all")
def q_find_all(spark, sf_dir):
    """M1: every leftmost-shortest non-overlapping D1 match in `documents`, with positions."""
    return search.find_all(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text", "retry")


@query("find_all_walk")
def q_find_all_walk(spark, sf_dir):
    """M2: D1 matches found by the single walk that never retries a mismatching character."""
    return search.find_all(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text", "walk")


# ---- P1, P2: filters --------------------------------------------------------

@query("docs_matching")
def q_docs_matching(spark, sf_dir):
    """Documents with at least one D1 match."""
    return search.docs_matching(documents(spark, sf_dir), compiled_d1(spark)).select("doc_id")


@query("docs_not_matching")
def q_docs_not_matching(spark, sf_dir):
    """Documents without any D1 match."""
    return search.docs_not_matching(documents(spark, sf_dir), compiled_d1(spark)).select("doc_id")


# ---- R1-R3: rewriting -------------------------------------------------------

@query("replace_all")
def q_replace_all(spark, sf_dir):
    """Every document rewritten with D1 (unmatched text kept)."""
    return rewrite.replace_all(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text")


@query("replace_insert_before")
def q_replace_insert_before(spark, sf_dir):
    """R2: each replacement written before its match, the match kept."""
    return rewrite.replace_all(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text",
                               emit="insert_before")


@query("replace_line_break")
def q_replace_line_break(spark, sf_dir):
    """Replace with the line-break rule between consecutive replacements."""
    return rewrite.replace_all(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text",
                               line_break=True)


# ---- A1-A8: counts and reports ----------------------------------------------

@query("doc_match_counts")
def q_doc_match_counts(spark, sf_dir):
    """A1: D1 matches per document, zero included."""
    return report.doc_match_counts(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text")


@query("changed_docs_count")
def q_changed_docs_count(spark, sf_dir):
    """A2: number of documents the D1 rewrite changes."""
    return report.changed_docs_count(documents(spark, sf_dir), compiled_d1(spark))


@query("match_report")
def q_match_report(spark, sf_dir):
    """Per-document report lines of the D1 matches."""
    return report.match_report(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text")


@query("pattern_hit_counts")
def q_pattern_hit_counts(spark, sf_dir):
    """Hits per D1 line, zero for lines that never win."""
    return report.pattern_hit_counts(documents(spark, sf_dir), compiled_d1(spark), d1_frame(spark))


@query("scan_summary")
def q_scan_summary(spark, sf_dir):
    """Documents scanned, changed, matches found, characters read."""
    return report.scan_summary(documents(spark, sf_dir), compiled_d1(spark))


@query("resolve_replacement")
def q_resolve_replacement(spark, sf_dir):
    """Each D1 match with its replacement text, by id."""
    ms = search.find_all(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text")
    return search.resolve_replacement(ms, d1_frame(spark)).select(
        "doc_id", "ordinal", "replacement_id", "replacement")


# ---- dictionaries derived from the tables ------------------------------------

def benchmark_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of the words of `benchmark`, in text order (duplicates and shadowing abound).

    pattern = a word (maximal run of letters), replacement = ``W<length>`` so
    words of one length share a replacement id.
    """
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    w = b.select("item_id", F.posexplode(F.split("text", r"[^\p{L}]+")).alias("pos", "word"))
    w = w.where(F.length("word") > 0)
    return dic.dictionary_from_table(
        w.withColumn("_order", F.struct("item_id", "pos")), "word",
        F.concat(F.lit("W"), F.length("word").cast("string")), order_col="_order")


@query("dict_ids")
def q_dict_ids(spark, sf_dir):
    """A5: replacement ids by first appearance for the `benchmark` word dictionary."""
    return benchmark_vocabulary(spark, sf_dir)


@query("dict_prefix_nodes")
def q_dict_prefix_nodes(spark, sf_dir):
    """Trie nodes of the word dictionary as a prefix table with ids."""
    return dic.prefix_nodes(benchmark_vocabulary(spark, sf_dir))


@query("dict_breadth")
def q_dict_breadth(spark, sf_dir):
    """Children per trie node."""
    return dic.node_breadth(dic.prefix_nodes(benchmark_vocabulary(spark, sf_dir)))


@query("dict_depth")
def q_dict_depth(spark, sf_dir):
    """Depth below each trie node."""
    return dic.node_depth(benchmark_vocabulary(spark, sf_dir))


@query("dict_id_path")
def q_dict_id_path(spark, sf_dir):
    """T4: the trie nodes replacement id 3 passes through."""
    return dic.id_path_of(benchmark_vocabulary(spark, sf_dir), 3)


@query("dict_prefix_lookup")
def q_dict_prefix_lookup(spark, sf_dir):
    """P5: what can follow the prefix 'th' in the word dictionary."""
    return dic.prefix_lookup_of(benchmark_vocabulary(spark, sf_dir), "th")


@query("dict_lint")
def q_dict_lint(spark, sf_dir):
    """T5: duplicate and shadowed lines of the word dictionary."""
    return dic.dictionary_lint(benchmark_vocabulary(spark, sf_dir))


# ---- sources and sinks --------------------------------------------------------
# Stand-in inputs (pattern files, document files) are written by Spark from the
# tables into a fresh folder under the shared checkpoint folder; the queries then
# read them back through the library's loaders.

def _part_lines(spark: SparkSession, sf_dir: str, mark: str) -> DataFrame:
    """One pattern-file line per part, in p_partkey order, with text around the pairs."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return p.orderBy("p_partkey").select(F.concat(
        F.col("p_type"), F.lit(f" {mark}"), F.col("p_name"), F.lit(f"{mark} => {mark}"),
        F.col("p_brand"), F.lit(f"{mark} "), F.col("p_size").cast("string")).alias("value"))


def _write_lines(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = shared_dir(spark, name)
    lines.write.mode("overwrite").text(path)
    return path


@query("dict_load")
def q_dict_load(spark, sf_dir):
    """S3: load a pattern file written from `part` (name -> brand)."""
    path = _write_lines(spark, _part_lines(spark, sf_dir, '"'), "patterns")
    return dict_file.load_dictionary(spark, path)


@query("dict_load_grouping")
def q_dict_load_grouping(spark, sf_dir):
    """The same file format with ' as the grouping character."""
    path = _write_lines(spark, _part_lines(spark, sf_dir, "'"), "patterns-q")
    return dict_file.load_dictionary(spark, path, grouping="'")


@query("dict_rejects")
def q_dict_rejects(spark, sf_dir):
    """Malformed lines of a pattern file written from `events` (type, props)."""
    ev = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    lines = ev.orderBy("event_id").select(
        F.when(F.col("event_type") == "click", F.concat_ws(" ", "props", "props"))
         .when(F.col("event_type") == "view", F.concat(F.lit('"" "'), F.col("event_type"), F.lit('"')))
         .when(F.col("event_type") == "error", F.concat(F.lit('"'), F.col("event_type"), F.lit('""')))
         .when(F.col("event_type") == "signup", F.col("event_type"))
         .otherwise(F.concat_ws(" ", "event_type", "props")).alias("value"))
    path = _write_lines(spark, lines, "patterns-bad")
    return dict_file.dictionary_rejects_file(spark, path)


@query("dict_saved")
def q_dict_saved(spark, sf_dir):
    """The word dictionary saved as a table and read back."""
    path = shared_dir(spark, "dictionary")
    dict_file.save_dictionary(benchmark_vocabulary(spark, sf_dir), path)
    return dict_file.read_saved_dictionary(spark, path)


@query("corpus_scan")
def q_corpus_scan(spark, sf_dir):
    """`documents` written as one text file per document, scanned back as files."""
    folders = sinks.write_files(documents(spark, sf_dir), shared_dir(spark, "corpus"), "doc_id", "text")
    files = corpus.read_files(spark, folders, recursive=True)
    dec = corpus.decode_bom(files)
    return dec.select(sinks.file_key(F.col("path"), "doc_id").alias("doc_id"), F.col("length").alias("n_bytes"),
                      F.length("text").cast("bigint").alias("n_chars"))


# The byte order mark and charset each language's stand-in file uses.
LANG_ENCODING = {"en": ("EFBBBF", "UTF-8"), "fr": ("FFFE", "UTF-16LE"),
                 "de": ("FEFF", "UTF-16BE"), "es": ("", "UTF-8")}


@query("decode_bom")
def q_decode_bom(spark, sf_dir):
    """Documents encoded with a byte order mark per language, decoded back by BOM."""
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    content = F.encode("text", "UTF-8")  # any other language, or none: no mark
    for lang, (bom, cs) in LANG_ENCODING.items():
        content = F.when(F.col("lang") == lang,
                         F.concat(F.unhex(F.lit(bom)), F.encode("text", cs))).otherwise(content)
    files = d.select("doc_id", content.alias("content"))
    return corpus.decode_bom(files).select("doc_id", "charset", "text")


@query("rewrite_sink")
def q_rewrite_sink(spark, sf_dir):
    """Changed documents of the D1 rewrite written as a new version, read back."""
    root = shared_dir(spark, "rewrites")
    rw = rewrite.replace_all(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text")
    sinks.write_rewrites(rw, root)
    return sinks.read_version(spark, root).select("doc_id", "text", "n_matches")


@query("log_sink")
def q_log_sink(spark, sf_dir):
    """The D1 match log written as text lines, read back."""
    path = shared_dir(spark, "log") + "/log"
    lines = report.match_lines(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text")
    sinks.write_log(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# ---- P3 alias, U1 union --------------------------------------------------------

@query("placeholder_alias")
def q_placeholder_alias(spark, sf_dir):
    """A dictionary whose '~' stands for '{', searched in `events.props`."""
    key = ("ALIAS", *_session_key(spark))
    if key not in _COMPILED:
        _COMPILED[key] = dic.compile_dictionary(
            dic.dictionary_from_pairs(spark, fixtures.ALIAS_DICT), alias=dic.DEFAULT_ALIAS)
    ev = table(spark, sf_dir, "events", "event_id", "props")
    return search.find_all(ev, _COMPILED[key], "event_id", "props")


@query("corpus_union")
def q_corpus_union(spark, sf_dir):
    """`documents`, `pages` and `conversations` searched as one corpus (D1 counts)."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"),
        "text")
    u = corpus.corpus_union([
        ("documents", documents(spark, sf_dir), "doc_id", "text"),
        ("pages", table(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html"),
        ("conversations", conv, "k", "text"),
    ])
    return report.doc_match_counts(u, compiled_d1(spark), ["source", "key"], "text")


# ---- M3-M6: large, table and regex dictionaries ---------------------------------

def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every `benchmark` passage is a pattern (they contain newlines)."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    return dic.dictionary_from_table(
        b, "text", F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("]")),
        order_col="item_id")


@query("contains_pairs")
def q_contains_pairs(spark, sf_dir):
    """M4: (document, benchmark item) pairs where the passage occurs in the document."""
    return search.contains_pairs(documents(spark, sf_dir),
                                 table(spark, sf_dir, "benchmark", "item_id", "text"),
                                 "doc_id", "text", "item_id", "text")


@query("find_all_anchor")
def q_find_all_anchor(spark, sf_dir):
    """M3+M5: `benchmark` passages found in `documents` through the anchor join."""
    return anchor.find_all_anchor(documents(spark, sf_dir), benchmark_passages(spark, sf_dir),
                                  "doc_id", "text")


@query("resolve_overlaps")
def q_resolve_overlaps(spark, sf_dir):
    """M5: all overlapping D1 occurrences from the anchor join, resolved greedily (= find_all)."""
    found = anchor.find_candidates(documents(spark, sf_dir), d1_frame(spark), "doc_id", "text", row_id=True)
    return anchor.resolve_overlaps(found, "doc_id")


@query("find_all_regex")
def q_find_all_regex(spark, sf_dir):
    """M6: matches of the regex dictionary D3 (lazy quantifiers, line order on ties)."""
    rows = [(i, p, r) for i, (p, r) in enumerate(fixtures.D3)]
    return search.find_all_regex(documents(spark, sf_dir), rows, "doc_id", "text")


@query("find_all_regex_large")
def q_find_all_regex_large(spark, sf_dir):
    """M6 with many lines: every `benchmark` word of nine letters or more with any fourth character,
    found through the factors that a document contains."""
    words = benchmark_vocabulary(spark, sf_dir).where("length(pattern) >= 9")
    rows = words.select("line_no", F.expr("concat(substring(pattern, 1, 3), '.', substring(pattern, 5))").alias("pattern"),
                        "replacement")
    return search.find_all_regex(documents(spark, sf_dir), rows, "doc_id", "text")


# ---- beyond one regex: the routes without limits, on D1 ----------------------------

@query("find_all_walk_large")
def q_find_all_walk_large(spark, sf_dir):
    """M2 through tables of prefix keys, as for dictionaries of any size (= find_all_walk)."""
    return walk.find_all_walk(documents(spark, sf_dir), d1_frame(spark), "doc_id", "text")


@query("replace_line_break_large")
def q_replace_line_break_large(spark, sf_dir):
    """R3 from match rows, written block by block (= replace_line_break)."""
    return large.replace_all_large(documents(spark, sf_dir), d1_frame(spark), "doc_id", "text", line_break=True)


@query("scan_summary_large")
def q_scan_summary_large(spark, sf_dir):
    """A2, A3, A8 from match rows (= scan_summary)."""
    return large.scan_summary_large(documents(spark, sf_dir), d1_frame(spark))


@query("docs_matching_large")
def q_docs_matching_large(spark, sf_dir):
    """P1 by a semi join with the documents that hold a candidate (= docs_matching)."""
    return large.docs_matching_large(documents(spark, sf_dir), d1_frame(spark)).select("doc_id")


# ---- X1: streaming ----------------------------------------------------------------

@query("incremental_scan")
def q_incremental_scan(spark, sf_dir):
    """`documents` arrive as files in two batches (English, then the rest); two
    incremental runs each search only the new files; the appended matches equal
    the batch find_all."""
    base = shared_dir(spark, "stream")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    docs.where(F.col("lang") == "en").select("doc_id", "text").write.parquet(src)
    matches = incremental.match_stream(spark, src, "doc_id BIGINT, text STRING",
                                       compiled_d1(spark), "doc_id", "text")
    incremental.run_once(matches, sink, ckpt)
    docs.where(~F.col("lang").eqNullSafe("en")).select("doc_id", "text").write.mode("append").parquet(src)
    incremental.run_once(matches, sink, ckpt)
    return spark.read.parquet(sink)


@query("incremental_scan_large")
def q_incremental_scan_large(spark, sf_dir):
    """X1 with a growing dictionary: `documents` arrive in two batches and D1 in two parts; the later
    files are searched for all lines, the earlier ones again for the later lines only."""
    base = shared_dir(spark, "arrivals")
    docs, d = table(spark, sf_dir, "documents", "doc_id", "lang", "text"), d1_frame(spark)
    for files, lines in ((F.col("lang") == "en", F.col("line_no") < 6),
                         (~F.col("lang").eqNullSafe("en"), F.lit(True))):
        docs.where(files).select("doc_id", "text").write.mode("append").parquet(f"{base}/in")
        incremental.scan_arrivals(spark, f"{base}/in", "doc_id BIGINT, text STRING", d.where(lines), f"{base}/out", "doc_id")
    return incremental.arrived_matches(spark, f"{base}/out", "doc_id")


@query("dict_branching")
def q_dict_branching(spark, sf_dir):
    """T1/A6 compact: where the trie of the `benchmark` words branches, with the number of ids through each node."""
    d = benchmark_vocabulary(spark, sf_dir)
    nodes = dic.branching_nodes(d)
    ids = dic.node_ids(d, nodes).groupBy("depth", "node").agg(F.sum(F.bitmap_count("ids")).alias("n_ids"))
    texts = dic.valid_rows(d).select("line_no", "pattern")
    return nodes.join(texts, "line_no").join(ids, ["depth", "node"]).select(
        F.substring("pattern", F.lit(1), F.col("depth")).alias("prefix"), "depth", "n_ids")


@query("find_all_auto")
def q_find_all_auto(spark, sf_dir):
    """Strategy choice: the `benchmark` word dictionary (thousands of patterns) over
    `documents`, by regex while it fits one, else by the anchor join."""
    return strategy.find_all_auto(documents(spark, sf_dir), benchmark_vocabulary(spark, sf_dir),
                                  "doc_id", "text")


@query("replace_all_large")
def q_replace_all_large(spark, sf_dir):
    """R1/R4 beyond one regex: `documents` rewritten with the `benchmark` word dictionary,
    from the match table of the anchor join."""
    return large.replace_all_large(documents(spark, sf_dir), benchmark_vocabulary(spark, sf_dir), "doc_id", "text")


@query("files_rewritten")
def q_files_rewritten(spark, sf_dir):
    """S1 to S7 in one run: `documents` written as one binary file row each with a byte order
    mark per language, decoded, rewritten with D1, encoded back and written as a version."""
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    content = F.encode("text", "UTF-8")
    for lang, (bom, cs) in LANG_ENCODING.items():
        content = F.when(F.col("lang") == lang,
                         F.concat(F.unhex(F.lit(bom)), F.encode("text", cs))).otherwise(content)
    files = corpus.decode_bom(d.select("doc_id", content.alias("content")))
    rw = rewrite.replace_all(files, compiled_d1(spark), ["doc_id", "charset", "bom"], "text")
    root = shared_dir(spark, "file-rewrites")
    sinks.write_rewrites(corpus.reencode(rw), root)
    back = corpus.decode_bom(sinks.read_version(spark, root).select("doc_id", "content", "n_matches"))
    return back.select("doc_id", "charset", "text", "n_matches", F.octet_length("content").alias("n_bytes"))


@query("line_scan")
def q_line_scan(spark, sf_dir):
    """S1 line route: `documents` written as text files (in doc_id order), read back
    splittably line by line, D1 matches per line; patterns have no line breaks."""
    cd = compiled_d1(spark)
    if not corpus.line_safe(cd.patterns):
        raise ValueError("a pattern contains a line break: use whole documents")
    path = shared_dir(spark, "lines")
    table(spark, sf_dir, "documents", "doc_id", "text").orderBy("doc_id").select("text") \
        .write.text(path)
    lines = corpus.read_lines(spark, path)
    return search.find_all(lines, cd, "line_no", "text")


@query("replace_literal")
def q_replace_literal(spark, sf_dir):
    """R2+R3 with M2: the reference writer's literal output over its literal walk:
    replacement inserted before each walk match, the match kept, line-break rule."""
    return rewrite.replace_all(documents(spark, sf_dir), compiled_d1(spark), "doc_id", "text",
                               emit="insert_before", line_break=True, mode="walk")
