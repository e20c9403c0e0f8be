"""Column expressions over a document's token array.

A document is cut into contiguous tokens (matches and the text between them)
by one regex scan; everything downstream (positions, rewrites, reports) is an
array expression on that row, so searching needs no shuffle. The one helper
outside the JVM is the running sum of token lengths (positions): Spark has no
scan over an array, and the nested-lambda ways to build one cost seconds of
query analysis, so a vectorised Arrow UDF does it on the length arrays only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_regex(retry_regex: str, first_class: str | None = None) -> str:
    """Tokens for the retry policy: a match, or the run of text up to the next one.

    ``L | .+?(?=L) | .+``: the lazy run stops right where the next match
    starts, which is where a left-to-right ``find`` would resume. The lazy
    single-character loop is iterative in Java's engine, so long gaps cannot
    overflow the stack. ``first_class`` (the characters patterns start with)
    guards the lookahead: at most positions one bit test rejects it before
    the alternation is tried.
    """
    guard = f"(?={first_class})" if first_class else ""
    return f"(?s)(?:{retry_regex})|.+?{guard}(?=(?:{retry_regex}))|.+"


def tokens(text: Column, regex: str | None) -> Column:
    """Contiguous tokens of ``text``; a single token when nothing can match."""
    if regex is None:
        return (F.when(F.length(text) > 0, F.array(text))
                 .when(text.isNotNull(), F.array().cast("array<string>")))
    return F.regexp_extract_all(text, F.lit(regex), 0)


RUN = 1 << 19  # tokens whose ends are computed together


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running_ends(lengths: pa.Array) -> pa.Array:
    """Inclusive running sum of each integer list: the end offset of every token.

    Vectorised over runs of rows (one ``cumsum`` for all of a run, then each row's
    base subtracted), O(total tokens); runs are short enough that what a worker
    holds beside the batch does not grow with it. Only the lengths travel to
    Python, never the text.
    """
    lengths = lengths.cast(pa.list_(pa.int32()))
    offs = lengths.offsets.to_numpy()
    # a sliced batch: offsets index into the whole values buffer
    vals = lengths.values.slice(offs[0], offs[-1] - offs[0]).to_numpy(zero_copy_only=False)
    offs = offs - offs[0]
    out = np.empty(len(vals), np.int32)
    a = 0
    while a < len(lengths):
        z = max(a + 1, int(np.searchsorted(offs, offs[a] + RUN, side="right")) - 1)
        cs = np.cumsum(vals[offs[a]:offs[z]], dtype=np.int64)
        base = np.concatenate([[0], cs])[offs[a:z] - offs[a]]
        out[offs[a]:offs[z]] = cs - np.repeat(base, np.diff(offs[a:z + 1]))
        a = z
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(out), mask=lengths.is_null())
