"""Rewriting: each match becomes its own replacement, all else is kept.

Works on the token array of a document (see ``search.tokenize``), so a rewrite
is a projection in the same stage as the search. A single ``regexp_replace``
cannot pick a replacement per pattern, and chained replaces are wrong (a
replacement could be matched again); mapping tokens is neither.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionary import CompiledDictionary, any_size
from .search import _keys, tokenize

EMITS = ("replace", "insert_before")


def _gap_ok(gap: Column, newline: str) -> Column:
    """A gap needs no inserted line break if it is spaces then a newline, or only spaces."""
    if newline == "\n":
        rx = "^ *(?:\n|\\z)"
    elif newline == "\r\n":
        rx = "^ *(?:\r\n|\r?\\z)"
    else:
        raise ValueError("newline must be '\\n' or '\\r\\n'")
    return gap.rlike(rx)


def rewrite_tokens(tok: Column, cd: CompiledDictionary, emit: str = "replace",
                   line_break: bool = False, newline: str = "\n") -> Column:
    """The rewritten text of one document from its token array.

    ``emit='replace'`` (R1) writes the replacement in place of the match;
    ``'insert_before'`` (R2) writes it before the match and keeps the match.
    ``line_break`` (R3) follows each replacement that has another match after
    it with a newline unless the gap to that match is spaces then a newline,
    or only spaces; with ``insert_before`` the gap starts with the kept match.
    Matches and maximal gaps alternate in the tokens of both modes, so the gap
    after a match is the next token, if that is not a match.
    """
    if emit not in EMITS:
        raise ValueError(f"emit must be one of {EMITS}")

    def out_of(t: Column) -> Column:
        r = F.coalesce(cd.replacement(t), F.lit(""))
        return r if emit == "replace" else F.concat(r, t)

    if not line_break:
        return F.array_join(F.transform(
            tok, lambda t: F.when(cd.is_match(t), out_of(t)).otherwise(t)), "")

    flags = F.transform(tok, lambda t: cd.is_match(t))

    def piece(t: Column, i: Column, b: Column) -> Column:
        a, f = b["a"], b["f"]
        n = F.size(a)
        own = t if emit == "insert_before" else F.lit("")
        nxt_gap = (i + 1 < n) & ~f[F.least(i + 1, n - 1)]
        has_next = F.when(nxt_gap, i + 2 < n).otherwise(i + 1 < n)
        decisive = F.concat(own, F.when(nxt_gap, a[F.least(i + 1, n - 1)]).otherwise(F.lit("")))
        brk = F.when(has_next & ~_gap_ok(decisive, newline), F.lit(newline)).otherwise(F.lit(""))
        # the newline opens the next gap; with insert_before that gap starts
        # with this match's own text, so it goes between replacement and match
        repl = F.coalesce(cd.replacement(t), F.lit(""))
        done = F.concat(repl, brk) if emit == "replace" else F.concat(repl, brk, t)
        return F.when(f[i], done).otherwise(t)

    bundle = F.array(F.struct(tok.alias("a"), flags.alias("f")))
    return F.transform(bundle, lambda b: F.array_join(
        F.transform(b["a"], lambda t, i: piece(t, i, b)), ""))[0]


@any_size("replace_all_large")
def replace_all(df: DataFrame, cd: CompiledDictionary, key: str | Sequence[str] = "doc_id",
                text: str = "text", emit: str = "replace", line_break: bool = False,
                newline: str = "\n", mode: str = "retry") -> DataFrame:
    """``<key>, text, n_matches`` for every document (unchanged ones too).

    ``n_matches = 0`` marks a document the rewrite leaves as it is; filter on
    ``n_matches > 0`` for the changed set.
    """
    keys = _keys(key)
    toks = tokenize(df, cd, keys, text, mode)
    tok = F.col("_tok")
    n = F.coalesce(F.size(F.filter(tok, lambda t: cd.is_match(t))), F.lit(0))
    return toks.select(*keys, rewrite_tokens(tok, cd, emit, line_break, newline).alias("text"),
                       n.cast("int").alias("n_matches"))
