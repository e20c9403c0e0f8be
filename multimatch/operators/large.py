"""Rewriting, filters, counts and reports for dictionaries of any size.

``search``, ``rewrite`` and ``report`` read one compiled regex; a dictionary too
large for one is searched by the anchor join (retry) or the prefix tables (walk)
instead, and everything else is derived here from match rows. Documents get a
number of their own and are written once, so that match rows can be joined back to
them whatever their keys; texts are read again only where a rewrite needs them.

While the patterns fit in the tasks, a task has all matches of a document's window, in
order (retry mode): it rewrites the window there, and filters without match rows.

Beyond, a rewrite cuts the changed documents into blocks of ``BLOCK`` characters. A block is
written from its own matches and from what reaches into it: the end of the last
match before it, and, for the line-break rule, what the first decisive block after
it says. Both are running values over small block rows; the texts of the blocks
stay spread over the tasks until a document is put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texthash import SEPARATOR, codes, windows
from ..session import written
from .anchor import _plain, find_all_anchor, find_candidates, in_tasks, pieces
from .dictionary import valid_rows
from .report import _label
from .rewrite import EMITS, _gap_ok
from .search import MODES, _keys
from .walk import find_all_walk

DOC = "_doc"  # a number of the document's own
BLOCK = 2048
MATCHES = "array<struct<start:int,end:int,replacement:string>>"


def find_all_large(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] = "doc_id", text: str = "text",
                   mode: str = "retry", alias=None, **kw) -> DataFrame:
    """M1/M2 for any dictionary, as ``search.find_all``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    find = find_all_anchor if mode == "retry" else find_all_walk
    return find(df, dictionary, key, text, alias=alias, **kw)


def _numbered(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    out = df.select(*columns, F.col(text).alias("_text"), F.monotonically_increasing_id().alias(DOC))
    return written(out, "documents")


def _matches(docs: DataFrame, dictionary: DataFrame, mode: str, alias, kw) -> DataFrame:
    """The match rows of numbered documents, with ``_doc`` as their key."""
    return find_all_large(docs.select(DOC, "_text"), dictionary, DOC, "_text", mode, alias, **kw)


def _replacements(matches: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Match rows with their replacement; an unknown id gives an empty one."""
    texts = dictionary.groupBy("replacement_id").agg(F.first("replacement").alias("replacement"))
    return matches.join(texts, "replacement_id", "left").withColumn(
        "replacement", F.coalesce("replacement", F.lit("")))


def replace_all_large(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] = "doc_id",
                      text: str = "text", emit: str = "replace", line_break: bool = False,
                      newline: str = "\n", mode: str = "retry", alias=None, block: int = BLOCK, **kw) -> DataFrame:
    """R1-R3 for any dictionary: ``<key>, text, n_matches``, as ``rewrite.replace_all``. A null text stays null."""
    if emit not in EMITS:
        raise ValueError(f"emit must be one of {EMITS}")
    if newline not in ("\n", "\r\n"):
        raise ValueError("newline must be '\\n' or '\\r\\n'")
    keys = _keys(key)
    texts = _short_replacements(dictionary, kw.get("broadcast_chars", REPLACED)) if mode == "retry" else None
    model = in_tasks(df, text, dictionary, alias=alias, **kw) if texts is not None else None
    if model is not None:
        done = _rewriter(*model, texts, emit == "insert_before", line_break, newline)(F.col(text)).alias("_new")
        return df.select(*keys, F.col(text).alias("_text"), done).select(
            *keys, F.coalesce("_new.text", "_text").alias("text"), F.col("_new.n_matches").alias("n_matches"))
    docs = _numbered(df, keys, text)
    found = written(_replacements(_matches(docs, dictionary, mode, alias, kw), dictionary), "matches")
    counts = found.groupBy(DOC).agg(F.count(F.lit(1)).cast("int").alias("n_matches"))
    pieces = _blocks(docs.join(counts.select(DOC), DOC, "left_semi"), found, emit, newline, block)
    out = F.concat("head", "tail")
    if line_break:
        pieces = written(pieces, "pieces")
        following = Window.partitionBy(DOC).orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)
        # a gap that is only spaces up to the end of its block is settled by the first block that says more
        later = pieces.select(DOC, "_blk", F.first("opens", ignorenulls=True).over(following).alias("_later"))
        pieces = pieces.join(later, [DOC, "_blk"])
        ends = F.coalesce("breaks", "_later", F.lit(False)) & F.col("goes_on")
        out = F.concat("head_breaks", F.when(ends, F.lit(newline)).otherwise(F.lit("")), "tail")
    whole = pieces.select(DOC, F.struct("_blk", out.alias("t")).alias("p")).groupBy(DOC).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "").alias("_new"))
    return (docs.join(whole, DOC, "left").join(counts, DOC, "left")
            .select(*keys, F.coalesce("_new", "_text").alias("text"), F.coalesce("n_matches", F.lit(0)).alias("n_matches")))


REPLACED = 1 << 25  # characters of replacements in the tasks


def _short_replacements(dictionary: DataFrame, limit: int) -> dict[int, str] | None:
    """The replacements by id, unless they are too many or too long for the tasks."""
    by_id = dictionary.groupBy("replacement_id").agg(F.first("replacement").alias("r"))
    st = by_id.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("r")), F.lit(0)).alias("chars")).first()
    if st["n"] > 500_000 or st["chars"] > limit:
        return None
    return {x["replacement_id"]: x["r"] or "" for x in by_id.collect()}


def _bodies(batches: Iterator[pa.Array]):
    """The texts of batches of a text column, in pieces."""
    return pieces((pa.RecordBatch.from_arrays([a], ["t"]) for a in batches), 0)


def _spans(source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of ``source``, one after the other."""
    first = np.cumsum(length) - length
    return source[np.repeat(begin - first, length) + np.arange(int(length.sum()))]


def _decoded(chars: np.ndarray) -> str:
    return chars.tobytes().decode("utf-32-le", "surrogatepass")


def _rewriter(lines, longest: int, texts: dict[int, str], keep: bool, line_break: bool, newline: str):
    """A function of a text: ``text`` rewritten (null: as it is) and ``n_matches``; ``keep`` leaves the matches in."""
    def table(known):
        """All replacements, the line break behind them, and where each pattern's begins."""
        by_line = [texts.get(i, "") for i in known.table["replacement_id"].tolist()]
        size = np.array([len(t) for t in by_line], np.int64)
        return codes("".join(by_line) + newline), np.cumsum(size) - size, size

    def needs_break(chars, solid, resume, following):
        """Whether the gaps from ``resume`` to ``following`` are neither only spaces nor spaces and then a line break."""
        at = np.append(solid, len(chars))[np.searchsorted(solid, resume)]
        padded = np.append(chars, [SEPARATOR, SEPARATOR])
        spaces = at >= following
        if newline == "\n":
            return ~(spaces | (padded[at] == 10))
        return ~(spaces | ((padded[at] == 13) & ((at + 1 >= following) | (padded[at + 1] == 10))))

    def text_of(parts, gaps, body):
        """A long document from its windows' parts; a gap that reaches into a later window is read from its text."""
        for slot, resume, following in gaps:
            gap = body[resume:following].lstrip(" ")
            if gap and not (gap.startswith(newline) or (newline == "\r\n" and gap == "\r")):
                parts[slot] = newline
        return "".join(parts)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = lines()
        pool, begin, size = table(known)
        for batch in batches:
            out = []
            for b in _bodies([batch]):
                bodies = _plain(b, 0)
                new, n = [None] * len(bodies), np.zeros(len(bodies), np.int32)
                entry, parts, gaps, pending = 0, [], [], None
                for w in windows(bodies, longest - 1) if longest else ():
                    at, p, after = known.matches(w, entry)
                    row, start = w.locate(at)
                    np.add.at(n, row, 1)
                    end = at + known.plen[p]
                    resume = at if keep else end
                    same = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
                    breaks = np.zeros(len(at), np.int64)
                    if line_break and len(at):
                        solid = np.flatnonzero(w.codes != 32)
                        inside = np.flatnonzero(same)
                        breaks[inside] = needs_break(w.codes, solid, resume[inside], at[inside + 1]) * len(newline)
                    # what comes before each match, its replacement, a line break; then the rest
                    source = np.concatenate([w.codes[:w.own], pool])
                    came = np.concatenate([[0 if keep else entry], resume])
                    till = np.concatenate([at, [w.own]])
                    first = np.column_stack([came, np.append(w.own + begin[p], 0),
                                             np.full(len(at) + 1, w.own + len(pool) - len(newline))]).ravel()
                    length = np.column_stack([np.maximum(till - came, 0), np.append(size[p], 0), np.append(breaks, 0)]).ravel()
                    if len(w.rows) > 1 or (w.skip == 0 and not w.goes_on):
                        made = _spans(source, first, length)
                        cut = np.append(np.flatnonzero(made == SEPARATOR), len(made))
                        changed, a = set(row.tolist()), 0
                        for r, z in zip(w.rows.tolist(), cut.tolist()):
                            if r in changed:
                                new[r] = _decoded(made[a:z])
                            a = z + 1
                        entry = after
                        continue
                    # a window of a long document: the break after its last match depends on a later window
                    r, own = int(w.rows[0]), _spans(source, first, length)
                    own, tail = (own[:-int(length[-3])], own[-int(length[-3]):]) if length[-3] else (own, own[:0])
                    if len(at) and pending is not None:
                        gaps.append((*pending, int(start[0])))
                    parts.append(_decoded(own[own != SEPARATOR]))
                    if len(at):
                        parts.append("")
                        pending = (len(parts) - 1, int(start[-1] + (0 if keep else known.plen[p[-1]])))
                    parts.append(_decoded(tail[tail != SEPARATOR]))
                    if not w.goes_on:
                        if n[r]:
                            new[r] = text_of(parts, gaps if line_break else [], bodies[r])
                        parts, gaps, pending = [], [], None
                    entry = after
                out.append(pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(n)], ["text", "n_matches"]))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("text", pa.string()), ("n_matches", pa.int32())]))

    return F.arrow_udf(run, "text string, n_matches int")


def _has_match(lines, longest: int):
    """A function of a text: whether a pattern occurs in it (null: no)."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = lines()
        for batch in batches:
            out = [np.zeros(0, bool)]
            for b in _bodies([batch]):
                hit = np.zeros(b.num_rows, bool)
                for w in windows(_plain(b, 0), longest - 1):
                    hit[w.locate(known.occurrences(w)[0])[0]] = True
                out.append(hit)
            yield pa.array(np.concatenate(out))

    return F.arrow_udf(run, "boolean")


def _blocks(docs: DataFrame, found: DataFrame, emit: str, newline: str, size: int) -> DataFrame:
    """The blocks of changed documents, written as far as a block can know.

    ``_doc, _blk``; ``head`` up to the last replacement and, with line breaks after
    the earlier ones, ``head_breaks``; ``tail``, the rest; ``breaks``: whether a line
    break follows the last replacement (null: the block does not tell); ``goes_on``:
    whether a match follows in a later block; ``opens``: whether a gap that reaches
    this block with nothing but spaces needs a line break (null: only spaces here
    too).
    """
    parts = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{size}}}"), 0)
    with_next = F.transform(F.array(parts), lambda a: F.transform(a, lambda t, i: F.struct(
        t.alias("t"), F.coalesce(F.substring(F.try_element_at(a, i + 2), 1, 1), F.lit("")).alias("next"))))[0]
    texts = docs.select(DOC, F.posexplode(with_next).alias("_blk", "b")).select(DOC, "_blk", "b.t", "b.next")
    ms = found.groupBy(DOC, F.floor(F.col("start") / size).cast("int").alias("_blk")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("ms"))
    blocks = texts.join(ms, [DOC, "_blk"], "left")
    slim = docs.select(DOC, F.explode(F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / size).cast("int"))).alias("_blk"))
    slim = slim.join(ms.select(DOC, "_blk", F.col("ms")[0]["start"].alias("s"), F.element_at("ms", -1)["end"].alias("e")),
                     [DOC, "_blk"], "left")
    in_doc = Window.partitionBy(DOC).orderBy("_blk")
    slim = slim.select(
        DOC, "_blk", F.max("e").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.first("s", ignorenulls=True).over(in_doc.rowsBetween(1, Window.unboundedFollowing)).alias("following"))
    b = blocks.join(slim, [DOC, "_blk"]).withColumn("begin", F.col("_blk") * size)
    t, ms, n, begin = F.col("t"), F.col("ms"), F.coalesce(F.size("ms"), F.lit(0)), F.col("begin")
    stop = begin + F.length(t)

    def cut(a: Column, z: Column) -> Column:
        """The text from place ``a`` to place ``z`` of the document, both in this block."""
        return F.substring(t, a - begin + 1, F.greatest(z - a, F.lit(0)))

    enter = F.greatest(begin, F.coalesce("carry", F.lit(0))) if emit == "replace" else begin
    resume = "end" if emit == "replace" else "start"
    ordered = F.when(n > 0, ms).otherwise(F.array().cast(MATCHES))

    def piece(breaks: bool):
        def one(m, i):
            here = F.concat(cut(F.when(i > 0, F.get(ms, i - 1)[resume]).otherwise(enter), m["start"]), m["replacement"])
            if not breaks:
                return here
            gap = cut(m[resume], F.get(ms, i + 1)["start"])
            return F.concat(here, F.when((i + 1 < n) & ~_gap_ok(gap, newline), F.lit(newline)).otherwise(F.lit("")))
        return F.array_join(F.transform(ordered, one), "")

    def says(rest: Column) -> Column:
        """Whether the end of the block breaks a gap: null if it is only spaces, else whether no line break comes first."""
        ok = F.concat(rest, "next").rlike(f"^ *{newline}")
        if newline == "\r\n":  # a gap may end between the two
            ok = ok | (rest.rlike("^ *\r\\z") & F.coalesce(F.col("following") == stop, F.lit(False)))
        return F.when(~rest.rlike("^ *\\z"), ~ok)

    after = F.least(F.when(n > 0, F.element_at(ms, -1)[resume]).otherwise(enter), stop)
    tail = cut(after, stop)
    lead = cut(F.least(enter, stop), F.when(n > 0, ms[0]["start"]).otherwise(stop))
    return b.select(
        DOC, "_blk", piece(False).alias("head"), piece(True).alias("head_breaks"), tail.alias("tail"),
        F.when(n > 0, says(tail)).otherwise(F.lit(False)).alias("breaks"),
        ((n > 0) & F.col("following").isNotNull()).alias("goes_on"),
        F.when(n > 0, ~_gap_ok(lead, newline)).otherwise(says(lead)).alias("opens"))


def docs_matching_large(df: DataFrame, dictionary: DataFrame, text: str = "text", negate: bool = False,
                        alias=None, **kw) -> DataFrame:
    """P1/P2 for any dictionary: the documents with (or, negated, without) a match.

    Any occurrence means a match, so overlaps need not be resolved.
    """
    cols = df.columns
    model = in_tasks(df, text, dictionary, alias=alias, **kw)
    if model is not None:
        hit = _has_match(*model)(F.col(text)) if model[1] else F.lit(False)
        return df.where(~hit if negate else hit)
    docs = _numbered(df, cols, text)
    hits = find_candidates(docs.select(DOC, "_text"), dictionary, DOC, "_text", alias=alias, **kw).select(DOC).distinct()
    return docs.join(hits, DOC, "left_anti" if negate else "left_semi").select(*cols)


def _counted(df: DataFrame, dictionary: DataFrame, keys: list[str], text: str, mode: str, alias, kw) -> DataFrame:
    """Every document's keys, ``_chars`` and ``n_matches``."""
    docs = _numbered(df, keys, text)
    counts = _matches(docs, dictionary, mode, alias, kw).groupBy(DOC).agg(F.count(F.lit(1)).alias("n"))
    return docs.select(DOC, *keys, F.length("_text").alias("_chars")).join(counts, DOC, "left").select(
        *keys, "_chars", F.coalesce("n", F.lit(0)).cast("int").alias("n_matches"))


def doc_match_counts_large(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] = "doc_id",
                           text: str = "text", mode: str = "retry", alias=None, **kw) -> DataFrame:
    """A1 for any dictionary: ``<key>, n_matches`` for every document, zero included."""
    return _counted(df, dictionary, _keys(key), text, mode, alias, kw).drop("_chars")


def changed_docs_count_large(df: DataFrame, dictionary: DataFrame, text: str = "text", mode: str = "retry",
                             alias=None, **kw) -> DataFrame:
    """A2 for any dictionary: ``n_changed``."""
    counted = _counted(df, dictionary, [], text, mode, alias, kw)
    return counted.agg(F.count_if(F.col("n_matches") > 0).cast("bigint").alias("n_changed"))


def scan_summary_large(df: DataFrame, dictionary: DataFrame, text: str = "text", mode: str = "retry", alias=None,
                       **kw) -> DataFrame:
    """A8 for any dictionary: ``n_docs, n_changed, n_matches, n_chars``."""
    return _counted(df, dictionary, [], text, mode, alias, kw).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs"),
        F.count_if(F.col("n_matches") > 0).cast("bigint").alias("n_changed"),
        F.coalesce(F.sum("n_matches"), F.lit(0)).cast("bigint").alias("n_matches"),
        F.coalesce(F.sum("_chars"), F.lit(0)).cast("bigint").alias("n_chars"))


def match_report_large(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] = "doc_id",
                       text: str = "text", mode: str = "retry", alias=None, **kw) -> DataFrame:
    """A4 for any dictionary: ``<key>, report`` for documents with a match."""
    keys = _keys(key)
    docs = _numbered(df, keys, text)
    found = _replacements(_matches(docs, dictionary, mode, alias, kw), dictionary)
    per_doc = found.groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct("ordinal", "replacement", "text"))).alias("_ms"))
    lines = F.transform("_ms", lambda m: F.concat(_label(keys), F.lit(":  "), m["replacement"], F.lit(" <- '"),
                                                  m["text"], F.lit("'")))
    return docs.select(DOC, *keys).join(per_doc, DOC).select(*keys, F.array_join(lines, "\n").alias("report"))


def pattern_hit_counts_large(df: DataFrame, dictionary: DataFrame, text: str = "text", mode: str = "retry", alias=None,
                             **kw) -> DataFrame:
    """A7 for any dictionary: ``line_no, pattern, replacement_id, n_hits`` for every line."""
    docs = df.select(F.lit(0).alias("_k"), F.col(text).alias("_text"))
    hits = (find_all_large(docs, dictionary, "_k", "_text", mode, alias, **kw)
            .groupBy(F.col("text").alias("pattern")).agg(F.count(F.lit(1)).alias("_h")))
    winners = valid_rows(dictionary).groupBy("pattern").agg(F.min("line_no").alias("_win"))
    return (dictionary.join(winners, "pattern", "left").join(hits, "pattern", "left")
            .select("line_no", "pattern", "replacement_id",
                    F.when(F.col("line_no") == F.col("_win"), F.coalesce("_h", F.lit(0)))
                     .otherwise(F.lit(0)).cast("bigint").alias("n_hits")))
