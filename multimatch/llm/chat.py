"""Chat formatting from heterogeneous layouts, with DataFrame functions only.

A record is a JSON document. Its *schema fingerprint* is the hash of its nested
field paths (names and nesting, without types). Each declared ``Layout`` states
the paths it reads and where its turns are; its fingerprints select the mapping
that turns a record into canonical ``(role, text)`` turns. Records of no declared
layout get a null layout and no turns.

A variant holds no text of more than 20 million characters and 128 MB in all. The
fingerprint of a larger record comes from its skeleton, the record without its
texts, and its turns from the layout's own schema. What fails to parse is reported.

The template writes an assistant turn as ``<s>text</s>`` and any other turn as
``<s>[INST] role\\ntext [/INST]</s>``. Inside roles and texts a backslash becomes
``\\s`` and the first character of a control string ``\\l`` or ``\\q`` (a line
break in a role ``\\n``), so texts never hold a control string and come back
exactly. The loss mask is the span of every assistant text, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and where its turns are.

    ``paths`` (``a.b``, ``a[].b``) must all be there; any of ``optional`` may be.
    Either ``turns`` names an array with a ``role`` and a ``text`` field (and
    perhaps an ``order`` field), or ``fixed`` lists (role, field, more fields
    joined by an empty line if not empty) for a record that is its own turns.
    ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    fixed: tuple[tuple[str, ...], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), turns="messages"),
    Layout("turns", ("turns[].turn", "turns[].role", "turns[].text"), turns="turns", text="text", order="turn"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations",
           role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt-response", ("prompt", "response"), optional=("system",),
           fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt-completion", ("prompt", "completion"), optional=("system",),
           fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output"), optional=("input", "system"),
           fixed=(("system", "system"), ("user", "instruction", "input"), ("assistant", "output"))),
)


def shape_of(paths) -> str:
    """The canonical text of a set of field paths, as ``shape`` writes a record's."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def write(node: dict) -> str:
        if not node:
            return "?"
        body = []
        for name in sorted(node):
            inner = write(node[name])
            body.append(f"{name[:-2]}: ARRAY<{inner}>" if name.endswith("[]") else f"{name}: {inner}")
        return "OBJECT<" + ", ".join(body) + ">"

    return write(tree)


def shape(variant: Column) -> Column:
    """Nested field names of a variant, scalar types replaced by a question mark."""
    return F.regexp_replace(F.schema_of_variant(variant), r"\b(?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\s*\d+\))?(?=[,>]|$)", "?")


def fingerprint(variant: Column) -> Column:
    """Hash of a record's nested field paths."""
    return F.xxhash64(shape(variant))


def skeleton(record: Column) -> Column:
    """A JSON text with empty strings for its texts; an escape in a name becomes U+E000."""
    bare = F.regexp_replace(record, r"(?s)\\.", "\ue000")
    return F.regexp_replace(bare, r'"(?:([^"]*+)"(\s*+:)|[^"]*+")', '"$1"$2')


def field_types(layout: Layout) -> dict[str, str]:
    """The top fields that a layout reads, with their types."""
    if layout.turns:
        order = f"{layout.order} bigint, " if layout.order else ""
        return {layout.turns: f"array<struct<{order}`{layout.role}` string, `{layout.text}` string>>"}
    return {name: "string" for _, *names in layout.fixed for name in names}


def read_large(record: Column, layout: Layout) -> Column:
    """The fields of a JSON text of this layout, whatever its size (``__bad``: the text, if it fails to parse)."""
    fields = ", ".join(f"`{n}` {t}" for n, t in field_types(layout).items())
    return F.from_json(record, f"{fields}, __bad string",
                       {"maxStringLen": str(2 ** 31 - 1), "columnNameOfCorruptRecord": "__bad"})


def turns_of(variant: Column, layout: Layout, large: Column | None = None) -> Column:
    """Canonical turns of a record of this layout (null roles and texts: empty), of ``read_large`` if given."""
    empty = F.lit("")
    types = field_types(layout)

    def field(name: str) -> Column:
        return F.try_variant_get(variant, f"$.{name}", types[name]) if large is None else large[name]

    if layout.turns:
        rows = field(layout.turns)
        if layout.order:
            rows = F.sort_array(rows)

        def turn(t: Column) -> Column:
            role = F.coalesce(t[layout.role], empty)
            for old, new in layout.roles:
                role = F.when(t[layout.role] == old, F.lit(new)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(t[layout.text], empty).alias("text"))

        return F.transform(rows, turn)
    made = []
    for role, *names in layout.fixed:
        got = [field(n) for n in names]
        text = F.concat(F.coalesce(got[0], empty),
                        *[F.when(F.length(g) > 0, F.concat(F.lit("\n\n"), g)).otherwise(empty) for g in got[1:]])
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        if names[0] in layout.optional:  # an absent optional turn is no turn
            made.append(F.when(got[0].isNotNull(), F.array(turn)).otherwise(F.array().cast(
                "array<struct<role:string,text:string>>")))
        else:
            made.append(F.array(turn))
    return F.concat(*made)


def canonical(records: DataFrame, record_col: str = "record", layouts=LAYOUTS) -> DataFrame:
    """``records`` plus ``__layout`` (null: unknown), ``__turns`` (array of role, text) and ``__failed``.

    ``__failed`` tells whether a record that is not null could not be parsed.
    """
    v, fp = F.col("__variant"), F.col("__fingerprint")
    over = v.isNull() & F.col(record_col).isNotNull()
    name = F.lit(None).cast("string")
    none = F.array().cast("array<struct<role:string,text:string>>")
    turns, bad, large = none, F.lit(False), {}
    for k, layout in enumerate(layouts):
        shapes = [shape_of(layout.paths + extra) for k in range(len(layout.optional) + 1)
                  for extra in combinations(layout.optional, k)]
        mine = F.lit(False)
        for s in shapes:  # constant once folded
            mine = mine | (fp == F.xxhash64(F.lit(s)))
        mine = F.coalesce(mine, F.lit(False))
        big = F.col(f"__large{k}")
        large[f"__large{k}"] = F.when(mine & over, read_large(F.col(record_col), layout))
        bad = bad | (mine & over & (big.isNull() | big["__bad"].isNotNull()))
        name = F.when(mine, F.lit(layout.name)).otherwise(name)
        turns = F.when(mine & over, turns_of(v, layout, big)).when(mine, turns_of(v, layout)).otherwise(turns)
    out = records.withColumn("__variant", F.try_parse_json(record_col))
    out = out.withColumn("__skeleton", F.when(over, F.try_parse_json(skeleton(F.col(record_col)))))
    out = out.withColumn("__fingerprint", fingerprint(F.coalesce(v, F.col("__skeleton")))).withColumns(large)
    out = out.withColumn("__failed", (over & F.col("__skeleton").isNull()) | bad)
    good = ~F.col("__failed")
    return out.withColumn("__layout", F.when(good, name)).withColumn(
        "__turns", F.coalesce(F.when(good, turns), none)).drop("__variant", "__skeleton", "__fingerprint", *large)


def escape(text: Column) -> Column:
    """Make a text free of control strings, reversibly."""
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    text = F.regexp_replace(text, r"<(/?s>)", r"\\l$1")
    return F.regexp_replace(text, r"\[(/?INST\])", r"\\q$1")


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\q", "["), ("\\n", "\n"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_turns(turns: DataFrame, key: str) -> DataFrame:
    """``key, formatted, loss``: one text per key of (key, pos, role, text) rows, in order of pos.

    ``loss`` lists the spans (start, end) under the loss mask, in code points.
    Rows are brought together once by key; a conversation's text is one value, so
    its turns have to meet.
    """
    from pyspark.sql import Window

    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    body = escape(F.coalesce("text", F.lit("")))
    mine = F.coalesce(F.col("role") == "assistant", F.lit(False))
    piece = F.when(mine, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(
        F.concat(F.lit("<s>[INST] "), role, F.lit("\n"), body, F.lit(" [/INST]</s>")))
    rows = turns.select(key, "pos", piece.alias("piece"), F.when(mine, F.length(body)).alias("size"))
    before = F.sum(F.length("piece")).over(
        Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)) + 3)
    got = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "piece", "start", "size"))).alias("p"))
    spans = F.transform(F.filter("p", lambda t: t["size"].isNotNull()), lambda t: F.struct(
        t["start"].alias("start"), (t["start"] + t["size"]).alias("end")))
    return got.select(key, F.array_join(F.transform("p", lambda t: t["piece"]), "").alias("formatted"),
                      spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        other = x.startswith("<s>[INST] ")
        head = F.substring_index(F.substr(x, F.lit(11)), "\n", 1)
        tail = F.substr(x, F.length(head) + 12)
        text = F.when(other, F.substr(tail, F.lit(1), F.length(tail) - 8)).otherwise(F.substr(x, F.lit(4)))
        return F.struct(F.when(other, unescape(head)).otherwise(F.lit("assistant")).alias("role"),
                        unescape(text).alias("text"))

    return F.transform(pieces, turn)


def format_records(records: DataFrame, key: str, record_col: str = "record", layouts=LAYOUTS) -> DataFrame:
    """``key, formatted, loss, failed`` of JSON records of any declared layout.

    One text per key; records of equal key (repeats) are formatted each on its
    own row. Null, malformed or unknown records give an empty text and no spans;
    ``failed`` is true of those that are not null and could not be parsed;
    null roles and texts are empty; other columns are ignored; an empty table
    gives an empty result.
    """
    rows = records.select(F.col(key).alias("__key"), F.col(record_col).alias("__record"))
    rows = canonical(rows.groupBy("__key", "__record").agg(F.count(F.lit(1)).alias("__n")), "__record", layouts)
    # repeats are formatted once; the hash tells records of one key apart
    rows = rows.select(F.struct("__key", F.xxhash64("__record"), "__n", "__failed").alias("k"),
                       F.posexplode_outer("__turns").alias("pos", "turn"))
    out = format_turns(rows.where("pos IS NOT NULL").select("k", "pos", "turn.role", "turn.text"), "k")
    none = rows.where("pos IS NULL").select("k", F.lit("").alias("formatted"),
                                            F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))
    return out.unionByName(none).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("k.__n")))).select(
        F.col("k.__key").alias(key), "formatted", "loss", F.col("k.__failed").alias("failed"))


def records_of(conversations: DataFrame) -> DataFrame:
    """Stand-in records in several layouts, one per conversation of (conv_id, turn, role, text) rows.

    Turns stand by number, null first; turns of one number by role, then by text.
    Null roles and texts are empty. Rows with a null id are one conversation.
    """
    turns = conversations.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    pair = F.struct(F.col("turns")[0]["text"].alias("prompt"), F.get("turns", F.lit(1))["text"].alias("response"))
    messages = F.struct(F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    record = (F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(pair))
              .when(F.coalesce(F.col("conv_id") % 2 == 0, F.lit(False))
                    | F.exists("turns", lambda t: t["turn"].isNull()), F.to_json(messages))
              .otherwise(F.to_json(F.struct("turns"))))
    return one.select("conv_id", record.alias("record"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and digests of what is read back from the formatted texts.

    Repeated rows are turns of their own; null ids, turns, roles and texts are as
    ``records_of`` says; an empty table leaves the conversation -7.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)],
                                  "conv_id bigint, turn bigint, role string, text string")
    out = format_records(records_of(rows.unionByName(extra)), "conv_id")
    unread = F.raise_error(F.concat(F.lit("unread record of conversation "), F.coalesce(
        F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    out = out.withColumn("formatted", F.when(F.col("failed"), unread).otherwise(F.col("formatted")))
    turns = read_back(F.col("formatted"))
    out = out.withColumn("turns", turns).withColumn("masked", F.array_join(F.transform("loss", lambda s: unescape(
        F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(whole, 256).alias("turns_sha256"),
                      F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
          + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS n,
        length(role) + length(regexp_replace(role, '[^\\\n]', '', 'g'))
          + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN role = 'assistant' THEN 7 ELSE r + 23 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
