"""multimatch: multi-pattern search and replace over Spark DataFrames.

Public API (DataFrame in, DataFrame out):

* dictionaries: ``dictionary_from_pairs``, ``dictionary_from_table``,
  ``load_dictionary`` (pattern files), ``compile_dictionary``,
  ``dictionary_lint``, ``prefix_nodes``;
* search: ``find_all`` (modes ``retry`` and ``walk``), ``find_all_anchor`` and
  ``find_all_walk`` (dictionaries of any size), ``find_all_regex``,
  ``contains_pairs``, ``docs_matching``, ``docs_not_matching``;
* rewrite: ``replace_all`` (``emit='replace'|'insert_before'``, ``line_break``);
* reports: ``match_report``, ``match_lines``, ``doc_match_counts``,
  ``pattern_hit_counts``, ``scan_summary``, ``observed``;

  search, rewrite and reports take a compiled dictionary, or a dictionary table of
  any size;
* sources / sinks: ``read_files``, ``read_lines``, ``decode_bom``, ``reencode``,
  ``corpus_union``,
  ``write_rewrites``, ``write_log``; streaming: ``match_stream``.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python helpers run inside Spark tasks (the Arrow running sum, the per-document
# overlap resolution); ship their code with the task instead of requiring the
# package to be importable on every executor.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .operators.anchor import find_all_anchor, find_candidates, resolve_overlaps  # noqa: E402
from .operators.dictionary import (  # noqa: E402
    compile_dictionary, dictionary_from_pairs, dictionary_from_table, dictionary_lint, prefix_ids,
    prefix_nodes)
from .operators.report import (  # noqa: E402
    changed_docs_count, doc_match_counts, match_lines, match_report, observed, pattern_hit_counts, scan_summary)
from .operators.rewrite import replace_all  # noqa: E402
from .operators.search import (  # noqa: E402
    contains_pairs, docs_matching, docs_not_matching, find_all, find_all_regex, regex_rejects)
from .operators.walk import find_all_walk  # noqa: E402
from .sources.corpus import corpus_union, decode_bom, read_files, read_lines, reencode  # noqa: E402
from .sources.dictionary_file import load_dictionary  # noqa: E402
from .sources.sinks import write_log, write_rewrites  # noqa: E402
from .streaming.incremental import match_stream  # noqa: E402

__all__ = [
    "compile_dictionary", "dictionary_from_pairs", "dictionary_from_table", "dictionary_lint",
    "prefix_ids", "prefix_nodes", "load_dictionary", "find_all", "find_all_anchor", "find_candidates",
    "resolve_overlaps", "find_all_regex", "regex_rejects", "find_all_walk", "contains_pairs", "docs_matching", "docs_not_matching",
    "changed_docs_count", "doc_match_counts", "match_lines", "match_report", "observed", "pattern_hit_counts",
    "scan_summary", "replace_all",
    "read_files", "read_lines", "decode_bom", "reencode", "corpus_union", "write_rewrites", "write_log", "match_stream",
]
