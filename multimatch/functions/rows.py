"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, cond: Column, *cols: Column) -> DataFrame:
    """``df.where(cond).select(*cols)`` with every expression evaluated once per row.

    A plain filter on a computed column is pushed below the projection with
    the expression inlined, so e.g. a token regex would run twice; a
    generator over a one-element (or null) array is not pushed through.
    """
    return df.select(F.inline(F.when(cond, F.array(F.struct(*cols)))))
