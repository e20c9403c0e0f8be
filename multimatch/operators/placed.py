"""Regex lines whose texts stand at fixed distances: the documents they may match, in one pass.

Tasks get the lines. A line's longest factor is looked up at every place of the
corpus by hashes (``anchor.Patterns``); where it stands, the line's other factors
have to stand at their distances from it, which their hashes say. What is left out
cannot match; what is kept is scanned with the line's regex afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texthash import KeySet, Rolling, Window, codes, mix, windows
from .anchor import DEFAULT_Q, Patterns, _anchors, _measured, _plain, pieces

LINES = "array<struct<line_no:int,regex:string>>"


def _spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``first[x]`` to ``first[x + 1]`` of each ``x`` in ``of``, and the place in ``of`` of each."""
    many = first[of + 1] - first[of]
    return (np.repeat(first[of] - (np.cumsum(many) - many), many) + np.arange(many.sum()),
            np.repeat(np.arange(len(of)), many))


class Placed:
    """The lines ``(line_no, regex, factors, offsets)`` with the anchors of their longest factors' texts."""

    def __init__(self, rows: Sequence[tuple], table: dict[str, np.ndarray], texts: list[str]):
        self.model = Patterns(table)
        index = {t: i for i, t in enumerate(texts)}
        owners, others, keys, self.span = [], [], [], 1
        for line, (_, _, factors, offsets) in enumerate(rows):
            best = longest(factors)
            owners += [(index[t], line, offsets[best]) for t in factors[best]]
            for f, (alternatives, offset) in enumerate(zip(factors, offsets)):
                self.span = max(self.span, offset + len(alternatives[0]) - min(offsets))
                if f != best:
                    number = np.uint64(len(others))
                    others.append((line, offset, len(alternatives[0])))
                    for t in alternatives:
                        full = Rolling(codes(t)).at(np.zeros(1, np.int64), np.array([len(t)]))
                        keys.append(mix(full ^ mix(np.array([number])))[0])
        owners = np.array(sorted(owners), np.int64).reshape(-1, 3)
        self.owner_first = np.searchsorted(owners[:, 0], np.arange(len(texts) + 1))
        self.owner_line, self.owner_offset = owners[:, 1], owners[:, 2]
        others = np.array(others, np.int64).reshape(-1, 3)
        self.other_first = np.searchsorted(others[:, 0], np.arange(len(rows) + 1))
        self.other_offset, self.other_length = others[:, 1], others[:, 2]
        self.keys = KeySet(np.array(keys, np.uint64))

    def candidates(self, w: Window) -> tuple[np.ndarray, np.ndarray]:
        """Places where a line's longest factor stands, with the line, if its other factors stand there too.

        What would stand beyond the window's ends is not looked at.
        """
        hashes = Rolling(w.codes)
        at, p = self.model.occurrences(hashes, w.own)
        entry, which = _spread(self.owner_first, p)
        at, line = at[which], self.owner_line[entry]
        begin = at - self.owner_offset[entry]
        other, which = _spread(self.other_first, line)
        place, length = begin[which] + self.other_offset[other], self.other_length[other]
        inside = np.flatnonzero((place >= 0) & (place + length < len(hashes.sums)))
        found = hashes.at(place[inside], length[inside])
        missing = ~self.keys.has(mix(found ^ mix(other[inside].astype(np.uint64))))
        ok = np.ones(len(at), bool)
        ok[which[inside[missing]]] = False
        return at[ok], line[ok]


def longest(factors: Sequence[Sequence[str]]) -> int:
    return max(range(len(factors)), key=lambda f: len(factors[f][0]))


def with_lines(docs: DataFrame, lines: DataFrame, every: bool) -> DataFrame:
    """``docs(..., _text)`` with ``_lines``, those of ``lines(line_no, regex, factors, offsets)`` that may match.

    Documents without such a line are left out, unless ``every`` is wanted. The
    lines have to fit in the tasks.
    """
    spark = docs.sparkSession
    rows = [tuple(r) for r in lines.select("line_no", "regex", "factors", "offsets").collect()]
    texts = spark.createDataFrame([(0, t, "", 0) for t in sorted({t for r in rows for t in r[2][longest(r[2])]})],
                                  "line_no INT, pattern STRING, replacement STRING, replacement_id INT")
    anchors = _anchors(docs, "_text", texts, DEFAULT_Q, None, False)
    got, classes = anchors.toArrow(), _measured(anchors)["n"]
    table = {c: got.column(c).to_numpy() for c in ("plen", "a", "o", "h", "full")}
    shared = spark.sparkContext.broadcast((Placed(rows, table, got.column("pattern").to_pylist()) if classes else None, rows))
    column, names = docs.columns.index("_text"), [*docs.columns, "_lines"]

    def run(batches):
        known, rows = shared.value
        structs = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], pa.string())], ["line_no", "regex"])
        for b in pieces(batches, column):
            pairs = [np.zeros(0, np.int64)]
            for w in windows(_plain(b, column), known.span - 1):
                at, line = known.candidates(w)
                pairs.append(np.unique(w.locate(at)[0] * len(rows) + line))
            row, line = np.divmod(np.unique(np.concatenate(pairs)), len(rows))
            mine = np.arange(b.num_rows) if every else np.unique(row)
            ends = np.append(np.searchsorted(row, mine), len(row)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), structs.take(pa.array(line)))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(mine)).columns, found], names)

    if not classes:
        none = docs.withColumn("_lines", F.array().cast(LINES))
        return none if every else none.limit(0)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_lines", T.ArrayType(T.StructType(
        [T.StructField("line_no", T.IntegerType()), T.StructField("regex", T.StringType())])))]))
