"""Matching operators: every match of every pattern in one pass, with positions.

``find_all`` (M1 retry / M2 walk) cuts each document into contiguous tokens
with one regex scan and derives positions with an in-row running sum, so the
whole search is one narrow stage: no shuffle, no UDF, no collect of the
corpus. The dictionary is compiled once on the driver after a size check.

Positions are 0-based character offsets (``start``) with an exclusive ``end``;
the reference's 1-based ``Start`` is ``start + 1``.

Operators that take a compiled dictionary take a dictionary table as well, of any
size: what is too large for a regex is searched as ``operators.large`` says.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.regex import RegexDialectError, can_be_empty, items_regex, pattern_items, placed_factors
from ..session import written
from .dictionary import CompiledDictionary, any_size

MODES = ("retry", "walk")
FEW = 16  # regex lines that are scanned for without an index
MIN_FACTOR = 2  # characters of a text that is worth looking up


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def scan_regex(cd: CompiledDictionary, mode: str) -> str | None:
    """The token regex of a mode (None for an empty dictionary)."""
    if mode == "retry":
        return tk.token_regex(cd.retry_regex, cd.first_class) if cd.retry_regex else None
    if mode == "walk":
        return cd.walk_regex
    raise ValueError(f"mode must be one of {MODES}")


def tokenize(df: DataFrame, cd: CompiledDictionary, key: str | Sequence[str], text: str = "text",
             mode: str = "retry", keep: Sequence[str] = ()) -> DataFrame:
    """``<key>, *keep, _tok``: the token array of each document (one regex scan)."""
    keys = _keys(key)
    return df.select(*keys, *keep, tk.tokens(F.col(text), scan_regex(cd, mode)).alias("_tok"))


def with_token_ends(toks: DataFrame) -> DataFrame:
    """Add ``_end``: the exclusive end offset of every token in ``_tok``."""
    return toks.withColumn("_end", tk.running_ends(F.transform("_tok", lambda t: F.length(t))))


def match_array(tok: Column, ends: Column, keep: Column) -> Column:
    """``array<struct<start INT, text STRING>>`` of the tokens ``keep`` accepts, in order."""
    pairs = F.zip_with(tok, ends, lambda t, e: F.struct(
        (e - F.length(t)).cast("int").alias("start"), t.alias("text")))
    return F.filter(pairs, keep)


@any_size("find_all_large")
def find_all(df: DataFrame, cd: CompiledDictionary, key: str | Sequence[str] = "doc_id",
             text: str = "text", mode: str = "retry") -> DataFrame:
    """M1/M2: ``<key>, ordinal, start, end, length, text, replacement_id``.

    ``retry``: every leftmost-shortest non-overlapping match. ``walk``: the
    reference's single pass that consumes a mismatching character instead of
    retrying it, so some matches are skipped.
    """
    keys = _keys(key)
    toks = with_token_ends(tokenize(df, cd, keys, text, mode))
    hits = match_array(F.col("_tok"), F.col("_end"), lambda s: cd.is_match(s["text"]))
    ms = toks.select(*keys, F.posexplode(hits).alias("ordinal", "m"))
    return ms.select(
        *keys,
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("m.start").alias("start"),
        (F.col("m.start") + F.length("m.text")).cast("int").alias("end"),
        F.length("m.text").cast("int").alias("length"),
        F.col("m.text").alias("text"),
        cd.replacement_id(F.col("m.text")).alias("replacement_id"),
    )


def any_match(text: Column, cd: CompiledDictionary) -> Column:
    """True iff some pattern occurs in ``text`` (null text: false)."""
    if cd.retry_regex is None:
        return F.lit(False)
    return F.coalesce(text.rlike(f"(?={cd.first_class})(?:{cd.retry_regex})"), F.lit(False))


@any_size("docs_matching_large")
def docs_matching(df: DataFrame, cd: CompiledDictionary, text: str = "text") -> DataFrame:
    """Documents with at least one match (a filter, stops at the first hit)."""
    return df.where(any_match(F.col(text), cd))


@any_size("docs_matching_large", negate=True)
def docs_not_matching(df: DataFrame, cd: CompiledDictionary, text: str = "text") -> DataFrame:
    """Documents with no match: skipped by the rewrite."""
    return df.where(~any_match(F.col(text), cd))


def resolve_replacement(matches: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Match id -> replacement text; an unknown id gives ``''``.

    The replacement list has one row per distinct replacement, a subset of the
    dictionary; it is joined by id (broadcast by the planner when small).
    """
    repl = dictionary.groupBy("replacement_id").agg(F.first("replacement").alias("replacement"))
    return matches.join(repl, "replacement_id", "left").withColumn(
        "replacement", F.coalesce(F.col("replacement"), F.lit("")))


def contains_pairs(docs: DataFrame, patterns: DataFrame, doc_key: str, doc_text: str,
                   pat_key: str, pat_text: str) -> DataFrame:
    """M4: (document, pattern) pairs where the pattern occurs; no positions.

    One row per document row and pattern row, whatever their keys. At every size
    the pairs come from the anchor join (all occurrences of every distinct
    pattern, shadowed ones and ones with NUL included), joined back to the
    pattern keys; empty and null patterns occur nowhere.
    """
    from .anchor import ROW, find_candidates
    p = patterns.select(F.col(pat_key).alias("_pk"), F.col(pat_text).alias("_pt")).where(
        F.length("_pt") > 0)
    d = docs.select(F.col(doc_key).alias("_dk"), F.col(doc_text).alias("_dt"))
    as_dict = p.select(F.lit(0).alias("line_no"), F.col("_pt").alias("pattern"),
                       F.lit("").alias("replacement"), F.lit(0).alias("replacement_id"))
    occ = find_candidates(d, as_dict, "_dk", "_dt", drop_shadowed=False, row_id=True)
    hits = occ.select(ROW, "_dk", F.col("text").alias("_pt")).distinct()
    return hits.join(p, "_pt").select(F.col("_dk").alias(doc_key), F.col("_pk").alias(pat_key))


REGEX_LINE = ("line_no int, replacement string, line string, reason string, regex string, "
              "factors array<array<string>>, places array<array<int>>")


def regex_lines(rows: Sequence[tuple[int, str, str]] | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """M6: the lines (line_no, pattern, replacement) of a regex dictionary, translated in the tasks.

    ``line_no, replacement, line, reason, regex, factors, places``: ``reason`` says why a
    line cannot be searched for (it is no pattern of the dialect, or matches the
    empty text: C16), null if it can; ``factors`` is what a matching text contains
    (one text of each), ``places`` where (see ``placed_factors``).
    """
    if not isinstance(rows, DataFrame):
        rows = spark.createDataFrame([tuple(r) for r in rows], "line_no INT, pattern STRING, replacement STRING")

    def run(batches):
        for b in batches:
            out = []
            for n, pattern, replacement in zip(*[c.to_pylist() for c in b.columns]):
                reason = regex = parts = places = None
                try:
                    items = pattern_items(pattern or "")
                    regex, placed = items_regex(items), placed_factors(items)
                    parts, places = [x[0] for x in placed], [list(x[1:]) for x in placed]
                    if can_be_empty(items):
                        reason = "matches the empty text"
                except RegexDialectError as e:
                    reason = str(e)
                out.append((n, replacement, pattern, reason, regex if reason is None else None, parts, places))
            kinds = [pa.int32(), *[pa.string()] * 4, pa.list_(pa.list_(pa.string())), pa.list_(pa.list_(pa.int32()))]
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                             ["line_no", "replacement", "line", "reason", "regex", "factors", "places"])

    src = rows.select(F.col("line_no").cast("int").alias("line_no"), "pattern", "replacement")
    return src.mapInArrow(run, REGEX_LINE)


def regex_rejects(rows: Sequence[tuple[int, str, str]] | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """``line_no, line, reason`` of the regex lines that are not searched for."""
    return regex_lines(rows, spark).where("reason IS NOT NULL").select("line_no", "line", "reason")


def find_all_regex(df: DataFrame, rows: Sequence[tuple[int, str, str]] | DataFrame,
                   key: str | Sequence[str], text: str = "text",
                   max_patterns: int = 100_000, few: int = FEW, broadcast_rows: int = 500_000,
                   broadcast_chars: int = 1 << 25) -> DataFrame:
    """M6: matches of a regex dictionary: ``<key>, ordinal, start, end, length, text, line_no``.

    ``rows`` is a list of (line_no, pattern, replacement) or a dictionary
    DataFrame with those columns. Quantifiers are lazy: matching stops at the
    first terminal. Ties at one start go to the earlier line. Lines that
    ``regex_rejects`` lists are left out.

    A document is scanned with one alternation of lines in line order: all of them
    if there are at most ``few``, else those whose factors it contains. Lines whose
    factors stand at fixed distances are looked up in one pass, while they fit in the
    tasks (``operators.placed``). The others' factors are found by the anchor join; per
    line the one in fewest documents says which documents come into question, and the
    others are looked up for these only.
    Lines without a factor of ``MIN_FACTOR`` characters are scanned for everywhere;
    of these there may be ``max_patterns``.
    """
    keys = _keys(key)
    spark = df.sparkSession
    lines = written(regex_lines(rows, spark).where("reason IS NULL"), "lines")
    n = lines.count()
    if n <= few:
        return _scan_lines(df.select(*keys, F.col(text).alias("_text")), keys, _always(lines.collect(), n))
    long_enough = F.filter(F.arrays_zip("factors", "places"), lambda z: F.length(z["factors"][0]) >= MIN_FACTOR)
    lines = lines.withColumn("_z", long_enough).select(
        "line_no", "regex", F.col("_z.factors").alias("factors"), F.col("_z.places").alias("places"))
    plain = lines.where(F.size("factors") == 0).select("line_no", "regex").limit(max_patterns + 1).collect()
    if len(plain) > max_patterns:
        raise ValueError(f"more than {max_patterns} regex lines without a text that a match must contain")
    lines = lines.where("size(factors) > 0 AND line_no IS NOT NULL").withColumn(
        "placed", F.size(F.array_distinct(F.transform("places", lambda p: p[0]))) == 1)
    chars = F.aggregate("factors", F.lit(0), lambda n, f: n + F.size(f) * F.length(f[0]))
    st = lines.agg(F.count_if("placed").alias("n"), F.sum(F.when(F.col("placed"), chars)).alias("chars"),
                   F.count_if(~F.col("placed")).alias("others")).first()
    fits = 0 < st["n"] <= broadcast_rows and st["chars"] <= broadcast_chars
    loose = lines.where(~F.col("placed")) if fits else lines
    some = st["others"] > 0 or (st["n"] > 0 and not fits)
    docs = df.select(*keys, F.col(text).alias("_text"))
    if some:
        docs = written(docs.withColumn("_doc", F.monotonically_increasing_id()), "documents")
        per_doc = _by_factors(docs, loose)
    parts = []
    if fits:
        from .placed import with_lines
        offsets = F.transform("places", lambda p: p[1])
        docs = with_lines(docs, lines.where("placed").withColumn("offsets", offsets), some or bool(plain))
        parts.append(F.col("_lines"))
    if some:
        docs = docs.join(per_doc, "_doc", "left" if fits or plain else "inner")
        parts.append(F.coalesce("_more", _always([], 0)))
    if plain:
        parts.append(_always(plain, len(plain)))
    # no line twice where there is no other
    return _scan_lines(docs, keys, F.array_distinct(F.array_sort(F.concat(*parts))) if plain
                       else F.array_sort(F.concat(*parts)))


def _by_factors(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``_doc, _more``: the ``lines(line_no, regex, factors)`` all of whose factors a document contains."""
    from .anchor import find_candidates
    every = written(lines.select("line_no", "regex", F.posexplode("factors").alias("f", "texts"))
                    .select("line_no", "f", F.explode("texts").alias("t")), "factors")
    texts = every.select(F.lit(0).alias("line_no"), F.col("t").alias("pattern"), F.lit("").alias("replacement"),
                         F.lit(0).alias("replacement_id")).distinct()
    found = find_candidates(docs.select("_doc", "_text"), texts, "_doc", "_text", drop_shadowed=False)
    found = written(found.select("_doc", F.col("text").alias("t")).distinct(), "found")
    # the factor of each line that fewest documents contain
    seen = found.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    cost = every.join(seen, "t", "left").groupBy("line_no", "f").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = cost.groupBy("line_no").agg(F.min(F.struct("n", "f")).alias("b"), F.count(F.lit(1)).alias("factors"))
    chosen = every.join(best.where("b.n > 0").select("line_no", F.col("b.f").alias("best"), "factors"), "line_no")
    cand = found.join(chosen.where("f = best").select("t", "line_no", "factors"), "t").select(
        "_doc", "line_no", "factors").distinct()
    others = cand.join(chosen.where("f <> best").select("line_no", "f", "t"), "line_no").join(
        found, ["_doc", "t"], "left_semi").groupBy("_doc", "line_no").agg(F.count_distinct("f").alias("others"))
    cand = cand.join(others, ["_doc", "line_no"], "left").where(F.col("factors") == F.coalesce("others", F.lit(0)) + 1)
    return cand.join(lines.select("line_no", "regex"), "line_no").groupBy("_doc").agg(
        F.collect_list(F.struct("line_no", "regex")).alias("_more"))


def _always(lines: Sequence, n: int) -> Column:
    """The lines (line_no, regex) as a constant array in line order."""
    if not n:
        return F.array().cast("array<struct<line_no:int,regex:string>>")
    return F.array(*[F.struct(F.lit(x["line_no"]).cast("int").alias("line_no"), F.lit(x["regex"]).alias("regex"))
                     for x in sorted(lines, key=lambda x: x["line_no"])])


def _scan_lines(docs: DataFrame, keys: list[str], lines: Column) -> DataFrame:
    """The matches of ``docs(<keys>, _text)``, each scanned with its own alternation of ``lines``.

    Tokens are taken twice, whole and as far as they are hits, so that no regex
    has to be compiled for a token.
    """
    docs = docs.select(*keys, "_text", lines.alias("_lines")).where(F.size("_lines") > 0)
    alt = F.concat(F.lit("(?:"), F.array_join(F.transform("_lines", lambda x: x["regex"]), ")|(?:"), F.lit(")"))
    regex = F.concat(F.lit("(?s)("), alt, F.lit(")|.+?(?=(?:"), alt, F.lit("))|.+"))
    docs = docs.withColumn("_rx", regex)
    toks = docs.select(*keys, "_lines", F.regexp_extract_all("_text", F.col("_rx"), 0).alias("_tok"),
                       F.regexp_extract_all("_text", F.col("_rx"), 1).alias("_hit"))
    toks = with_token_ends(toks)
    spans = F.transform(F.arrays_zip("_hit", "_end"), lambda p: F.struct(
        (p["_end"] - F.length(p["_hit"])).cast("int").alias("start"), p["_hit"].alias("text")))
    ms = toks.select(*keys, "_lines", F.posexplode(F.filter(spans, lambda p: p["text"] != "")).alias("ordinal", "m"))
    which = F.filter("_lines", lambda x: F.rlike(F.col("m.text"), F.concat(F.lit("^(?:"), x["regex"], F.lit(")\\z"))))
    return ms.select(
        *keys, F.col("ordinal").cast("int").alias("ordinal"), F.col("m.start").alias("start"),
        (F.col("m.start") + F.length("m.text")).cast("int").alias("end"),
        F.length("m.text").cast("int").alias("length"), F.col("m.text").alias("text"),
        which[0]["line_no"].alias("line_no"))
