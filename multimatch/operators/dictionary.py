"""Dictionary operators: ids, alias, rejects, dedupe, shadowing and the prefix table.

A dictionary is a DataFrame ``line_no INT, pattern STRING, replacement STRING,
replacement_id INT``. Everything here is a distributed job so dictionaries of
tens of millions of patterns work the same way as the 12-line test ones; only
``compile_dictionary`` collects, and only after checking the size.

Rules (fixed by the reference's intended semantics):

* replacement id = index of the first equal replacement, counted in order of
  first appearance (0-based);
* a duplicate pattern never wins: the first line does;
* a pattern that has another pattern as a proper prefix is shadowed: the walk
  stops at the first pattern end it reaches, so it can never match;
* an empty pattern, or one with a NUL before its end, is rejected.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import regex as rx
from ..session import written

DICT_SCHEMA = "line_no INT, pattern STRING, replacement STRING, replacement_id INT"
REJECT_SCHEMA = "line_no INT, line STRING, reason STRING"

# Fixed value: the pattern character the reference treats as matching '{'.
DEFAULT_ALIAS = {"~": "{"}


def running_total(df: DataFrame, order_cols: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Add the BIGINT sum of ``amount`` over all earlier rows in ``order_cols`` order, without a one-task window.

    Range-partition and sort (distributed) and add up inside each partition. The
    sorted rows are written once: a second evaluation could choose other range
    bounds, so the sums per partition and the rows must come from the same files.
    Only one offset per partition is broadcast.
    """
    order = [F.col(c) for c in order_cols]
    srt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_amount", amount.cast("bigint"))
    srt = materialize(srt.withColumn("_mid", F.monotonically_increasing_id()))
    srt = srt.withColumn("_pid", F.shiftright("_mid", 33))
    totals = srt.groupBy("_pid").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("_pid", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    out = srt.withColumn("_before", F.coalesce(F.sum("_amount").over(before), F.lit(0))).join(F.broadcast(starts), "_pid")
    return out.select(*df.columns, (F.col("_start") + F.col("_before")).alias(name))


def consecutive_index(df: DataFrame, order_cols: Sequence[str], name: str) -> DataFrame:
    """Add a 0-based consecutive BIGINT index in ``order_cols`` order.

    As ``running_total`` of one per row, but a row's place in its partition is
    read off ``monotonically_increasing_id`` (partition id in the high bits).
    """
    order = [F.col(c) for c in order_cols]
    srt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    srt = materialize(srt.withColumn("_mid", F.monotonically_increasing_id()))
    srt = srt.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_loc", F.col("_mid").bitwiseAND((1 << 33) - 1))
    counts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = srt.join(F.broadcast(offsets), "_pid", "left").withColumn(
        name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_loc"))
    return out.drop("_mid", "_pid", "_loc", "_off")


def assign_replacement_ids(df: DataFrame) -> DataFrame:
    """A5: replacement id = rank of the replacement's first line, 0-based.

    Input needs ``line_no, pattern, replacement``; output adds ``replacement_id``.
    """
    firsts = df.groupBy("replacement").agg(F.min("line_no").alias("_first"))
    ids = consecutive_index(firsts, ["_first"], "replacement_id").drop("_first")
    # one row per distinct replacement: bounded by the dictionary, shuffled join
    return (df.join(ids, "replacement", "left")
              .select(F.col("line_no").cast("int"), "pattern", "replacement",
                      F.col("replacement_id").cast("int")))


def materialize(df: DataFrame) -> DataFrame:
    """Write a derived dictionary once to the shared checkpoint folder.

    A dictionary feeds several branches of every analysis (dedupe, shadowing,
    lint, anchors); a table-derived or file-loaded one can be large, so it is
    computed once instead of once per branch, and its lineage is cut.
    """
    return written(df, "dictionary")


def dictionary_from_pairs(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Dictionary from (pattern, replacement) pairs given on the driver, in line order.

    The pairs are a parameter already in driver memory, so their replacement
    ids (first appearance order, as ``assign_replacement_ids``) are numbered
    here instead of by a distributed job; table- and file-derived
    dictionaries go through ``assign_replacement_ids``.
    """
    ids: dict[str, int] = {}
    rows = []
    for i, (p, r) in enumerate(pairs):
        rows.append((i, p, r, ids.setdefault(r, len(ids))))
    return spark.createDataFrame(rows, DICT_SCHEMA)


def dictionary_from_table(df: DataFrame, pattern_col: str, replacement: Column | None = None,
                          order_col: str | None = None) -> DataFrame:
    """Dictionary from any table: one pattern per row, lines ordered by ``order_col``."""
    order_col = order_col or pattern_col
    base = df.select(F.col(order_col).alias("_o"), F.col(pattern_col).alias("pattern"),
                     (replacement if replacement is not None else F.lit("")).alias("replacement"))
    base = consecutive_index(base, ["_o"], "line_no").drop("_o")
    return materialize(assign_replacement_ids(base))


def apply_alias(df: DataFrame, alias: Mapping[str, str] | None = None) -> DataFrame:
    """Pattern characters that stand for another input character."""
    alias = DEFAULT_ALIAS if alias is None else alias
    if not alias:
        return df
    src = "".join(alias.keys())
    dst = "".join(alias[k] for k in alias)
    return df.withColumn("pattern", F.translate("pattern", src, dst))


def reject_reason(pattern: Column) -> Column:
    """Why a dictionary row can never be searched for (null if fine)."""
    return (F.when(pattern.isNull() | (F.length(pattern) == 0), F.lit("empty pattern"))
             .when(F.instr(pattern, "\u0000") > 0, F.lit("NUL in pattern")))


def dictionary_rejects(df: DataFrame) -> DataFrame:
    """Rows of a dictionary that are rejected (empty pattern, embedded NUL)."""
    return (df.withColumn("reason", reject_reason(F.col("pattern")))
              .where(F.col("reason").isNotNull())
              .select("line_no", F.col("pattern").alias("line"), "reason"))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where(reject_reason(F.col("pattern")).isNull())


def first_per_pattern(df: DataFrame) -> DataFrame:
    """One row per distinct pattern, the first line's (partial aggregation)."""
    best = F.min(F.struct("line_no", "replacement", "replacement_id")).alias("_b")
    return df.groupBy("pattern").agg(best).select(
        F.col("_b.line_no").alias("line_no"), "pattern",
        F.col("_b.replacement").alias("replacement"),
        F.col("_b.replacement_id").alias("replacement_id"))


MAX_PREFIX_LENGTHS = 4096


def shadowed_patterns(distinct_patterns: DataFrame) -> DataFrame:
    """Patterns with another pattern as a proper prefix, with the shortest one.

    A pattern is cut only at the lengths that patterns have (collected, at most
    ``MAX_PREFIX_LENGTHS``; every length beyond that many), and what is shuffled
    is the hash of the cut; the text is compared after the join.
    """
    got = distinct_patterns.select(F.length("pattern").alias("n")).distinct().limit(MAX_PREFIX_LENGTHS + 1).collect()
    c = F.col("pattern")
    cuts = (F.array(*[F.lit(n) for n in sorted(r["n"] for r in got)]) if 0 < len(got) <= MAX_PREFIX_LENGTHS
            else F.sequence(F.lit(1), F.length(c)))
    cut = distinct_patterns.where(F.length("pattern") > 1).select("pattern", F.explode(
        F.filter(cuts, lambda n: n < F.length(c))).alias("n"))
    cut = cut.withColumn("h", F.xxhash64(F.substring(c, F.lit(1), F.col("n"))))
    short = distinct_patterns.select(c.alias("prefix"), F.length(c).alias("n"), F.xxhash64(c).alias("h"))
    hits = cut.join(short, ["n", "h"]).where(F.col("pattern").startswith(F.col("prefix")))
    return hits.groupBy("pattern").agg(F.min(F.struct("n", "prefix")).getField("prefix").alias("shadowed_by"))


def active_dictionary(df: DataFrame, alias: Mapping[str, str] | None = None) -> DataFrame:
    """The rows that can match: valid, first line per pattern, not shadowed."""
    if alias:
        df = apply_alias(df, alias)
    firsts = first_per_pattern(valid_rows(df))
    shadowed = shadowed_patterns(firsts.select("pattern"))
    return firsts.join(shadowed, "pattern", "left_anti").select(
        "line_no", "pattern", "replacement", "replacement_id")


def dictionary_lint(df: DataFrame) -> DataFrame:
    """T5: rows that will never win, each with a reason.

    ``line_no, pattern, issue, detail``: rejected rows, duplicates of an earlier
    line (detail says whether the replacement differs) and shadowed patterns.
    """
    rej = dictionary_rejects(df).select(
        "line_no", F.col("line").alias("pattern"), F.col("reason").alias("issue"),
        F.lit(None).cast("string").alias("detail"))
    ok = valid_rows(df)
    firsts = first_per_pattern(ok)
    dup = (ok.alias("o").join(firsts.alias("f"), "pattern")
             .where(F.col("o.line_no") != F.col("f.line_no"))
             .select(F.col("o.line_no").alias("line_no"), "pattern",
                     F.lit("duplicate").alias("issue"),
                     F.concat(F.lit("of line "), F.col("f.line_no").cast("string"),
                              F.when(F.col("o.replacement") != F.col("f.replacement"),
                                     F.lit(", other replacement")).otherwise(F.lit("")))
                     .alias("detail")))
    sh = (shadowed_patterns(firsts.select("pattern")).join(firsts, "pattern")
          .select("line_no", "pattern", F.lit("shadowed").alias("issue"),
                  F.concat(F.lit("by "), F.col("shadowed_by")).alias("detail")))
    return rej.unionByName(dup).unionByName(sh)


def prefix_ids(df: DataFrame) -> DataFrame:
    """``prefix STRING, id INT``: each trie node with each id passing through it.

    The normalised form of the trie: distinct on (prefix, id), so the root and
    other short prefixes, which every line passes through, are spread over
    tasks by id rather than gathered under one key.
    """
    ok = valid_rows(df)
    p = F.col("pattern")
    return ok.select(
        F.col("replacement_id").alias("id"),
        F.explode(F.transform(F.sequence(F.lit(0), F.length(p)),
                              lambda i: F.substring(p, 1, i))).alias("prefix")
    ).select("prefix", "id").distinct()


def prefix_nodes(df: DataFrame) -> DataFrame:
    """One row per distinct prefix (trie node) with the ids through it.

    ``prefix STRING, depth INT, parent STRING, ids ARRAY<INT>``; ``parent`` of a
    depth-1 node is the root ``''``, which is included (depth 0). A node's id
    list is as long as the number of distinct ids below it (the root lists
    them all); ``prefix_ids`` gives the same content one row per id.
    """
    return prefix_ids(df).groupBy("prefix").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        "prefix", F.length("prefix").cast("int").alias("depth"),
        F.when(F.length("prefix") > 0,
               F.expr("substring(prefix, 1, length(prefix) - 1)")).alias("parent"),
        "ids")


def node_breadth(nodes: DataFrame) -> DataFrame:
    """Number of child nodes under each node (leaves have 0)."""
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(
        F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).cast("int").alias("breadth"))
    return nodes.select("prefix").join(kids, "prefix", "left").select(
        "prefix", F.coalesce("breadth", F.lit(0)).alias("breadth"))


def node_depth(df: DataFrame) -> DataFrame:
    """How far below each node the deepest pattern through it ends."""
    ok = valid_rows(df)
    p = F.col("pattern")
    ex = ok.select(F.length(p).alias("n"),
                   F.explode(F.transform(F.sequence(F.lit(0), F.length(p)),
                                         lambda i: F.substring(p, 1, i))).alias("prefix"))
    return ex.groupBy("prefix").agg(
        (F.max("n") - F.length(F.col("prefix"))).cast("int").alias("depth_below"))


def id_path(nodes: DataFrame, replacement_id: int) -> DataFrame:
    """T4: the nodes an id passes through, root first."""
    return nodes.where(F.array_contains("ids", F.lit(replacement_id))).select("prefix", "depth")


def id_path_of(df: DataFrame, replacement_id: int) -> DataFrame:
    """T4 from the dictionary itself: only the lines with the id are exploded into prefixes."""
    ids = prefix_ids(df.where(F.col("replacement_id") == F.lit(replacement_id)))
    return ids.select("prefix", F.length("prefix").cast("int").alias("depth"))


def prefix_lookup_of(df: DataFrame, prefix: str) -> DataFrame:
    """P5 from the dictionary itself: only patterns that continue the prefix, cut to one more character."""
    kids = valid_rows(df).where(F.col("pattern").startswith(prefix) & (F.length("pattern") > len(prefix)))
    kids = kids.select(F.substring("pattern", 1, len(prefix) + 1).alias("child"), "replacement_id").distinct()
    return kids.groupBy("child").agg(F.sort_array(F.collect_list("replacement_id")).alias("ids")).select(
        "child", F.substring("child", len(prefix) + 1, 1).alias("next_char"), "ids")


def prefix_lookup(nodes: DataFrame, prefix: str) -> DataFrame:
    """P5: what continues a prefix: its children and their ids."""
    return nodes.where(F.col("parent") == F.lit(prefix)).select(
        F.col("prefix").alias("child"), F.substring("prefix", len(prefix) + 1, 1).alias("next_char"),
        "ids")


def _common(a: str, b: str) -> int:
    """Characters that two texts have in common at their beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def sorted_patterns(df: DataFrame) -> DataFrame:
    """``line_no, pattern, common``: the distinct valid patterns in order, with the number of
    characters each shares with the pattern before it (0 for the first).

    One range-partitioned sort; only the last pattern of a partition goes to the
    next one.
    """
    ok = first_per_pattern(valid_rows(df)).select("line_no", "pattern")
    srt = ok.repartitionByRange("pattern").sortWithinPartitions("pattern")
    srt = materialize(srt.withColumn("_mid", F.monotonically_increasing_id()))
    srt = srt.withColumn("_pid", F.shiftright("_mid", 33))
    lasts = srt.groupBy("_pid").agg(F.max_by("pattern", "_mid").alias("_last"), F.min("_mid").alias("_mid"))
    border = lasts.select("_mid", F.lag("_last").over(Window.orderBy("_pid")).alias("_border"))  # one row per partition
    near = F.lag("pattern").over(Window.partitionBy("_pid").orderBy("_mid"))
    pairs = srt.withColumn("_near", near).join(border, "_mid", "left").select(
        "line_no", "pattern", F.coalesce("_near", "_border").alias("before"))

    def run(batches):
        for b in batches:
            own, before = b.column(1).to_pylist(), b.column(2).to_pylist()
            common = [_common(x, y) if y is not None else 0 for x, y in zip(own, before)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common, pa.int32())],
                                             ["line_no", "pattern", "common"])

    return pairs.mapInArrow(run, "line_no int, pattern string, common int")


def branching_nodes(df: DataFrame) -> DataFrame:
    """T1 compact: ``line_no, depth, node``: where the trie branches, or a pattern goes on beyond another.

    Such a node is what two neighbours in the sorted dictionary have in common, so
    there are fewer nodes than patterns and none is written out: it is the first
    ``depth`` characters of the pattern of ``line_no``, and ``node`` is their hash.
    """
    srt = sorted_patterns(df)
    text = F.substring("pattern", F.lit(1), F.col("common"))
    return srt.select("line_no", F.col("common").alias("depth"), F.xxhash64(text, "common").alias("node")).groupBy(
        "depth", "node").agg(F.min("line_no").alias("line_no")).select("line_no", "depth", "node")


def node_ids(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """A6 compact: ``node, depth, bucket, ids``: the replacement ids through each branching node.

    ``ids`` is a bitmap of the ids of one bucket (32,768 of them), so that no row,
    the root's included, holds all ids. A pattern is cut only at depths where some
    node is (every depth if there are more than ``MAX_PREFIX_LENGTHS``).
    """
    nodes = materialize(nodes)
    got = nodes.select("depth").distinct().limit(MAX_PREFIX_LENGTHS + 1).collect()
    p = F.col("pattern")
    cuts = (F.array(*[F.lit(n) for n in sorted(r["depth"] for r in got)]) if 0 < len(got) <= MAX_PREFIX_LENGTHS
            else F.sequence(F.lit(0), F.length(p)))
    cut = valid_rows(df).select("pattern", "replacement_id", F.explode(F.filter(cuts, lambda n: n <= F.length(p))).alias("depth"))
    cut = cut.select("replacement_id", "depth", F.xxhash64(F.substring(p, F.lit(1), F.col("depth")), "depth").alias("node"))
    through = cut.join(nodes.select("depth", "node"), ["depth", "node"])
    bucket, place = F.bitmap_bucket_number("replacement_id"), F.bitmap_bit_position("replacement_id")
    return through.groupBy("node", "depth", bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("ids"))


class DictionaryTooLarge(ValueError):
    """The dictionary exceeds the size a single regex may have."""


def sql_string(s: str) -> str:
    """A Spark SQL string literal (backslash escapes are processed by the parser)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class CompiledDictionary:
    """Active dictionary rows on the driver, after a size check, and their regexes.

    In-row lookups (is this token a pattern, its replacement, its id) go through
    a hashed bucket table: a constant ``array<map>`` indexed by
    ``pmod(xxhash64(token), B)``, built from one SQL string (so building it costs
    one call whatever the dictionary size) and folded to a literal by the
    optimizer. A lookup is O(1) expected instead of a scan over all keys.
    """

    entries: list[tuple[int, str, str, int]]  # line_no, pattern, replacement, replacement_id
    patterns: list[str] = field(init=False)
    replacement_of: dict[str, str] = field(init=False)
    id_of: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.entries = sorted(self.entries)
        self.patterns = [e[1] for e in self.entries]
        self.replacement_of = {e[1]: e[2] for e in self.entries}
        self.id_of = {e[1]: e[3] for e in self.entries}
        # shortest first: with shadowed patterns removed the order does not
        # change the matches, but it keeps leftmost-shortest explicit
        self._by_len = sorted(self.patterns, key=lambda s: (len(s), s))
        self.retry_regex = rx.retry_regex(self._by_len)
        # the characters patterns start with, as a regex class
        firsts = sorted({p[0] for p in self.patterns})
        self.first_class = ("[" + "".join(rx.atom(c) for c in firsts) + "]") if firsts else None
        self._walk_regex: str | None = None
        self.n_buckets = 1 << max(0, (len(self.entries) - 1).bit_length())
        self._tables: dict[str, Column] = {}
        self._slots: dict[str, int] | None = None

    @property
    def empty(self) -> bool:
        return not self.entries

    # the walk regex nests one group per character of the longest pattern, and
    # Java's matcher recurses through the nesting
    MAX_WALK_DEPTH = 4000

    @property
    def walk_regex(self) -> str | None:
        """Nested trie regex for ``mode='walk'`` (built on first use)."""
        if self._walk_regex is None and self.entries:
            depth = max(len(p) for p in self.patterns)
            if depth > self.MAX_WALK_DEPTH:
                raise DictionaryTooLarge(
                    f"walk mode nests one group per character; the longest pattern has "
                    f"{depth} > {self.MAX_WALK_DEPTH}")
            self._walk_regex = rx.walk_regex(self._by_len)
        return self._walk_regex

    def _slot_of(self, tok: Column) -> Column:
        return (F.pmod(F.xxhash64(tok), F.lit(self.n_buckets)) + 1).cast("int")

    def _table(self, kind: str) -> Column:
        if kind not in self._tables:
            vtype = "string" if kind == "replacement" else "int"
            if self._slots is None:
                # the slot of each key, computed once by Spark's own hash function
                spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
                keys = spark.createDataFrame([(p,) for p in self.patterns], "k STRING")
                self._slots = {r.k: r.s for r in
                               keys.select("k", self._slot_of(F.col("k")).alias("s")).collect()}
            slots: list[list[str]] = [[] for _ in range(self.n_buckets)]
            for k, slot in self._slots.items():
                if kind == "replacement":
                    val = sql_string(self.replacement_of[k])
                else:
                    val = str(int(self.id_of[k]))
                slots[slot - 1] += [sql_string(k), val]
            maps = [f"map({', '.join(b)})" if b else f"cast(map() as map<string,{vtype}>)"
                    for b in slots]
            self._tables[kind] = F.expr(f"array({', '.join(maps)})")
        return self._tables[kind]

    def is_match(self, tok: Column) -> Column:
        """True iff the token is an active pattern (gaps and failed walks never are)."""
        if self.empty:
            return F.lit(False)
        return F.coalesce(F.map_contains_key(
            F.element_at(self._table("replacement"), self._slot_of(tok)), tok), F.lit(False))

    def replacement(self, tok: Column) -> Column:
        """The token's replacement (null if it is not a pattern)."""
        if self.empty:
            return F.lit(None).cast("string")
        return F.try_element_at(F.element_at(self._table("replacement"), self._slot_of(tok)), tok)

    def replacement_id(self, tok: Column) -> Column:
        """The token's replacement id (null if it is not a pattern)."""
        if self.empty:
            return F.lit(None).cast("int")
        return F.try_element_at(F.element_at(self._table("id"), self._slot_of(tok)), tok)


def compile_dictionary(df: DataFrame, alias: Mapping[str, str] | None = None,
                       max_patterns: int = 20_000, max_chars: int = 1 << 20) -> CompiledDictionary:
    """Collect the active dictionary once, after measuring it, and build the regexes.

    Patterns and replacements are measured before they are collected: a larger
    dictionary raises ``DictionaryTooLarge`` (the operators that take a dictionary
    table then search it without a regex) and none of it reaches the driver.
    """
    act = active_dictionary(df, alias)
    st = act.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("chars"),
                 F.coalesce(F.sum(F.length("replacement")), F.lit(0)).alias("written")).first()
    if st["n"] > max_patterns or max(st["chars"], st["written"]) > max_chars:
        raise DictionaryTooLarge(
            f"more than {max_patterns} patterns or {max_chars} characters of patterns or replacements; "
            f"use the anchor join")
    return CompiledDictionary([(r.line_no, r.pattern, r.replacement, r.replacement_id) for r in act.collect()])


def compiled_or_none(dictionary: DataFrame, mode: str = "retry", **limits) -> CompiledDictionary | None:
    """The compiled dictionary, or None if it is too large for one regex (in ``mode``)."""
    try:
        cd = compile_dictionary(dictionary, **limits)
        if mode == "walk":
            cd.walk_regex  # nests one group per character
        return cd
    except DictionaryTooLarge:
        return None


def any_size(large: str, **fixed) -> Callable:
    """Let an operator on a compiled dictionary take a dictionary table of any size too.

    A table is compiled if it is small enough; else the operator of
    ``operators.large`` named ``large`` is called with the same arguments.
    """
    def wrap(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def chosen(df, dictionary, *args, **kw):
            if not isinstance(dictionary, DataFrame):
                return operator(df, dictionary, *args, **kw)
            mode = signature.bind(df, dictionary, *args, **kw).arguments.get("mode", "retry")
            cd = compiled_or_none(dictionary, mode)
            if cd is not None:
                return operator(df, cd, *args, **kw)
            from . import large as module
            return getattr(module, large)(df, dictionary, *args, **kw, **fixed)
        return chosen
    return wrap
