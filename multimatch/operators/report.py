"""Counts and reports over matches.

Per-document figures are array expressions on the document's own row (no
shuffle). Per-pattern figures explode only the match texts and aggregate with
map-side partial aggregation, so a hot pattern is pre-counted in every task
before the exchange, which then carries at most one row per pattern per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.rows import keep_where
from .dictionary import CompiledDictionary, any_size, compiled_or_none, valid_rows
from .search import _keys, tokenize


def _match_texts(tok: Column, cd: CompiledDictionary) -> Column:
    return F.filter(tok, lambda t: cd.is_match(t))


def _label(keys: Sequence[str]) -> Column:
    if len(keys) == 1:
        return F.col(keys[0]).cast("string")
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


@any_size("doc_match_counts_large")
def doc_match_counts(df: DataFrame, cd: CompiledDictionary, key: str | Sequence[str] = "doc_id",
                     text: str = "text", mode: str = "retry") -> DataFrame:
    """A1: ``<key>, n_matches`` for every document, zero included."""
    keys = _keys(key)
    toks = tokenize(df, cd, keys, text, mode)
    n = F.coalesce(F.size(_match_texts(F.col("_tok"), cd)), F.lit(0))
    return toks.select(*keys, n.cast("int").alias("n_matches"))


@any_size("changed_docs_count_large")
def changed_docs_count(df: DataFrame, cd: CompiledDictionary, text: str = "text",
                       mode: str = "retry") -> DataFrame:
    """A2: ``n_changed``: documents the rewrite changes (some match)."""
    if mode == "retry":
        from .search import any_match
        return df.select(F.count_if(any_match(F.col(text), cd)).cast("bigint").alias("n_changed"))
    toks = tokenize(df, cd, [], text, mode)
    return toks.select(F.count_if(F.size(_match_texts(F.col("_tok"), cd)) > 0)
                       .cast("bigint").alias("n_changed"))


@any_size("match_report_large")
def match_report(df: DataFrame, cd: CompiledDictionary, key: str | Sequence[str] = "doc_id",
                 text: str = "text", mode: str = "retry") -> DataFrame:
    """A4 (with J1, J2): ``<key>, report`` for documents with a match.

    One line per match in text order, ``"{key}:  {replacement} <- '{match}'"``
    (two spaces), joined with newlines. An unknown id gives an empty
    replacement. The quoted text is that of the match itself, which is what
    the reference's "first match with the same start" lookup amounts to once
    every start is right.
    """
    keys = _keys(key)
    toks = tokenize(df, cd, keys, text, mode)
    ms = _match_texts(F.col("_tok"), cd)
    label = _label(keys)
    lines = toks.select(*keys, ms.alias("_ms"), label.alias("_label"))
    report = F.array_join(F.transform("_ms", lambda m: F.concat(
        F.col("_label"), F.lit(":  "), F.coalesce(cd.replacement(m), F.lit("")),
        F.lit(" <- '"), m, F.lit("'"))), "\n")
    return keep_where(lines, F.size("_ms") > 0, *[F.col(k) for k in keys], report.alias("report"))


def pattern_hit_counts(df: DataFrame, cd: CompiledDictionary | None, dictionary: DataFrame,
                       text: str = "text", mode: str = "retry") -> DataFrame:
    """``line_no, pattern, replacement_id, n_hits`` for every dictionary line.

    Lines that never win (duplicates, shadowed, rejected) report 0. Without a
    compiled dictionary it is compiled here, or searched otherwise if too large.
    """
    cd = cd or compiled_or_none(dictionary, mode)
    if cd is None:
        from .large import pattern_hit_counts_large
        return pattern_hit_counts_large(df, dictionary, text, mode)
    toks = tokenize(df, cd, [], text, mode)
    hits = (toks.select(F.explode(_match_texts(F.col("_tok"), cd)).alias("pattern"))
                .groupBy("pattern").agg(F.count(F.lit(1)).alias("_h")))
    winners = valid_rows(dictionary).groupBy("pattern").agg(F.min("line_no").alias("_win"))
    return (dictionary.join(winners, "pattern", "left").join(hits, "pattern", "left")
            .select("line_no", "pattern", "replacement_id",
                    F.when(F.col("line_no") == F.col("_win"), F.coalesce("_h", F.lit(0)))
                     .otherwise(F.lit(0)).cast("bigint").alias("n_hits")))


def match_lines(df: DataFrame, cd: CompiledDictionary, key: str | Sequence[str] = "doc_id",
                text: str = "text", mode: str = "retry") -> DataFrame:
    """``<key>, ordinal, line``: the report line of every match, a row each, whatever the match holds."""
    keys = _keys(key)
    toks = tokenize(df, cd, keys, text, mode).select(
        *keys, _label(keys).alias("_label"), F.posexplode(_match_texts(F.col("_tok"), cd)).alias("ordinal", "_m"))
    return toks.select(*keys, "ordinal", report_line(
        F.col("_label"), F.coalesce(cd.replacement(F.col("_m")), F.lit("")), F.col("_m")).alias("line"))


def report_line(label: Column, replacement: Column, match: Column) -> Column:
    return F.concat(label, F.lit(":  "), replacement, F.lit(" <- '"), match, F.lit("'"))


def observed(rewritten: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """A3/A8 live: a rewrite that counts as it runs, and its counters.

    ``n_docs, n_changed, n_matches`` are complete when the first action on the
    result ends (``counters.get``); while it runs, and for each batch of a stream,
    they are in the query's progress under ``name``.
    """
    counters = Observation(name)
    metrics = [F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n_matches") > 0).alias("n_changed"),
               F.coalesce(F.sum("n_matches"), F.lit(0)).alias("n_matches")]
    return rewritten.observe(name if rewritten.isStreaming else counters, *metrics), counters


def replacement_hit_counts(hit_counts: DataFrame) -> DataFrame:
    """A7 by replacement: ``replacement_id, n_hits``."""
    return hit_counts.groupBy("replacement_id").agg(F.sum("n_hits").cast("bigint").alias("n_hits"))


@any_size("scan_summary_large")
def scan_summary(df: DataFrame, cd: CompiledDictionary, text: str = "text",
                 mode: str = "retry") -> DataFrame:
    """One row ``n_docs, n_changed, n_matches, n_chars`` (complete / found / todo = 0)."""
    from .search import scan_regex
    toks = df.select(F.length(text).alias("_c"),
                     tk.tokens(F.col(text), scan_regex(cd, mode)).alias("_tok")).select(
        F.coalesce(F.size(_match_texts(F.col("_tok"), cd)), F.lit(0)).alias("_n"), "_c")
    return toks.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs"),
        F.count_if(F.col("_n") > 0).cast("bigint").alias("n_changed"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_matches"),
        F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n_chars"),
    )
