"""Choosing the search strategy from dictionary statistics.

Catalyst cannot choose between a regex scan and an anchor join, because the
choice depends on the dictionary's size, so the operators do it when they are
given a dictionary table (``operators.dictionary.any_size``):

* a dictionary that fits one regex (measured before it is collected) is compiled
  and scanned in one narrow stage; ``find_all_auto`` does so up to ``SMALL`` patterns,
  as more are found faster by hashes in the tasks;
* a larger one goes through the anchor join, or the prefix tables in walk mode.

Both give the same match table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.dictionary import compiled_or_none
from ..operators.large import find_all_large
from ..operators.search import find_all


SMALL = 64  # patterns


def find_all_auto(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] = "doc_id",
                  text: str = "text", max_patterns: int = SMALL, max_chars: int = 1 << 20,
                  alias=None, mode: str = "retry") -> DataFrame:
    """Matches by regex when the dictionary is small enough, else without one."""
    cd = compiled_or_none(dictionary, mode, alias=alias, max_patterns=max_patterns, max_chars=max_chars)
    if cd is None:
        return find_all_large(df, dictionary, key, text, mode, alias)
    return find_all(df, cd, key, text, mode)
