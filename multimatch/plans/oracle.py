"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Built from the raw fixed dictionaries, not from the engine's compiled form:
the literal oracle tokenises with a plain alternation ordered shortest first
(RE2 is leftmost-first, so the shortest pattern at a position wins, which also
makes shadowed patterns unreachable) and picks each pattern's first line
itself. Tokens ``(?s)L|.`` are contiguous, so positions are running sums.
"""

from __future__ import annotations

from . import fixtures

ORACLE: dict[str, str] = {}


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lit_rx(s: str) -> str:
    return "".join("\\x{%x}" % ord(c) for c in s)


def _walk_rx(patterns) -> str:
    """One token per walk from the root, written out from the rule (not the engine's builder).

    A walk is a run of characters that start nothing, or it follows a pattern
    until the pattern ends, until a character that goes on no pattern (which it
    takes with it), or until the text ends.
    """
    def rest(tails):
        if "" in tails:
            return ""
        heads = sorted({t[0] for t in tails})
        ways = [_lit_rx(h) + rest([t[1:] for t in tails if t[0] == h]) for h in heads]
        return "(?:" + "|".join([*ways, "[^" + _lit_rx(heads) + "]", "\\z"]) + ")"

    heads = sorted({p[0] for p in patterns})
    return "|".join(["[^" + _lit_rx(heads) + "]+",
                     *[_lit_rx(h) + rest([p[1:] for p in patterns if p[0] == h]) for h in heads]])


def _first_lines(pairs):
    """pattern -> (line_no, replacement, replacement_id) of its first valid line."""
    ids: dict[str, int] = {}
    for _, r in pairs:
        ids.setdefault(r, len(ids))
    first = {}
    for i, (p, r) in enumerate(pairs):
        if p and p not in first:
            first[p] = (i, r, ids[r])
    return first, ids


D1_FIRST, D1_IDS = _first_lines(fixtures.D1)
D1_ALT = "|".join(_lit_rx(p) for p in sorted(D1_FIRST, key=lambda s: (len(s), s)))
D1_TOK = f"(?s)(?:{D1_ALT})|."
D1_IN = ", ".join(sql_str(p) for p in D1_FIRST)
D1_ID_CASE = "CASE x " + " ".join(
    f"WHEN {sql_str(p)} THEN {v[2]}" for p, v in D1_FIRST.items()) + " END"
D1_REPL_CASE = "CASE x " + " ".join(
    f"WHEN {sql_str(p)} THEN {sql_str(v[1])}" for p, v in D1_FIRST.items()) + " ELSE x END"
# walk tokens come from the nested trie regex (checked against a literal
# simulation of the walk in the tests)
D1_WALK = _walk_rx(list(D1_FIRST))


def _token_rows(table: str, key: str, text: str, tok_rx: str) -> str:
    return f"""
t AS (SELECT {key}, regexp_extract_all({text}, {sql_str(tok_rx)}) AS tok FROM {table}),
u AS (SELECT {key}, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM t),
w AS (SELECT {key}, x, i,
             sum(length(x)) OVER (PARTITION BY {key} ORDER BY i
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - length(x) AS st FROM u)"""


def _find_all_sql(tok_rx: str) -> str:
    return f"""WITH {_token_rows('documents', 'doc_id', 'text', tok_rx)},
m AS (SELECT * FROM w WHERE x IN ({D1_IN}))
SELECT doc_id,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal,
       CAST(st AS INTEGER) AS start, CAST(st + length(x) AS INTEGER) AS "end",
       CAST(length(x) AS INTEGER) AS length, x AS text,
       CAST({D1_ID_CASE} AS INTEGER) AS replacement_id
FROM m"""


ORACLE["find_all"] = _find_all_sql(D1_TOK)
ORACLE["find_all_walk"] = _find_all_sql(D1_WALK)

ORACLE["docs_matching"] = f"SELECT doc_id FROM documents WHERE regexp_matches(text, {sql_str(D1_ALT)})"
ORACLE["docs_not_matching"] = (
    f"SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, {sql_str(D1_ALT)}), false)")


def _rewrite_sql(piece: str) -> str:
    return f"""SELECT doc_id,
       array_to_string(list_transform(regexp_extract_all(text, {sql_str(D1_TOK)}),
                                      lambda x: {piece}), '') AS text,
       CAST(len(list_filter(regexp_extract_all(text, {sql_str(D1_TOK)}),
                            lambda x: x IN ({D1_IN}))) AS INTEGER) AS n_matches
FROM documents"""


ORACLE["replace_all"] = _rewrite_sql(D1_REPL_CASE)
ORACLE["replace_insert_before"] = _rewrite_sql(
    f"CASE WHEN x IN ({D1_IN}) THEN ({D1_REPL_CASE}) || x ELSE x END")

# A newline after a replacement when another match follows and the gap to
# it is not "spaces then newline" nor only spaces. Per-character tokens: the gap
# after match k is the run of non-match tokens up to the next match.
def _line_break_sql(tok_rx: str, insert_before: bool) -> str:
    """R3 by tokens: the gap after match k is the run of non-match tokens up to
    the next match; a newline follows the replacement when another match comes
    and the checked text (the match itself first, with insert_before) is not
    spaces then a newline, nor only spaces."""
    checked = "g.x || coalesce(gp.gap, '')" if insert_before else "coalesce(gp.gap, '')"
    keep = " || g.x" if insert_before else ""
    return f"""WITH {_token_rows('documents', 'doc_id', 'text', tok_rx)},
f AS (SELECT doc_id, x, i, x IN ({D1_IN}) AS is_m FROM w),
g AS (SELECT doc_id, x, i, is_m,
             sum(CASE WHEN is_m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM f),
gaps AS (SELECT doc_id, grp, string_agg(x, '' ORDER BY i) AS gap FROM g WHERE NOT is_m GROUP BY doc_id, grp),
lastm AS (SELECT doc_id, max(grp) AS mx FROM g GROUP BY doc_id),
o AS (SELECT g.doc_id, g.i,
             CASE WHEN g.is_m THEN ({D1_REPL_CASE.replace('x ', 'g.x ', 1)})
                    || CASE WHEN g.grp < l.mx
                              AND NOT regexp_matches({checked}, '^ *(?:\\n|\\z)')
                            THEN chr(10) ELSE '' END{keep}
                  ELSE g.x END AS piece
      FROM g JOIN lastm l USING (doc_id)
      LEFT JOIN gaps gp ON gp.doc_id = g.doc_id AND gp.grp = g.grp)
SELECT d.doc_id, coalesce(r.text, d.text) AS text, coalesce(c.n, 0) AS n_matches
FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS text FROM o GROUP BY doc_id) r USING (doc_id)
LEFT JOIN (SELECT doc_id, CAST(count(*) FILTER (WHERE is_m) AS INTEGER) AS n FROM f GROUP BY doc_id) c USING (doc_id)"""


ORACLE["replace_line_break"] = _line_break_sql(D1_TOK, False)
# the reference writer's literal behaviour: walk tokens, insert before, line breaks
ORACLE["replace_literal"] = _line_break_sql(D1_WALK, True)

ORACLE["doc_match_counts"] = f"""SELECT doc_id,
       CAST(len(list_filter(regexp_extract_all(text, {sql_str(D1_TOK)}),
                            lambda x: x IN ({D1_IN}))) AS INTEGER) AS n_matches
FROM documents"""

ORACLE["changed_docs_count"] = (
    f"SELECT CAST(count(*) AS BIGINT) AS n_changed FROM documents "
    f"WHERE regexp_matches(text, {sql_str(D1_ALT)})")

ORACLE["match_report"] = f"""WITH {_token_rows('documents', 'doc_id', 'text', D1_TOK)},
m AS (SELECT doc_id, i, x FROM w WHERE x IN ({D1_IN}))
SELECT doc_id,
       string_agg(CAST(doc_id AS VARCHAR) || ':  ' || ({D1_REPL_CASE}) || ' <- ''' || x || '''',
                  chr(10) ORDER BY i) AS report
FROM m GROUP BY doc_id"""

_D1_ROWS = ", ".join(
    f"({i}, {sql_str(p)}, {D1_IDS[r]})" for i, (p, r) in enumerate(fixtures.D1))
ORACLE["pattern_hit_counts"] = f"""WITH {_token_rows('documents', 'doc_id', 'text', D1_TOK)},
h AS (SELECT x AS pattern, count(*) AS n FROM w WHERE x IN ({D1_IN}) GROUP BY x),
d(line_no, pattern, replacement_id) AS (VALUES {_D1_ROWS}),
win AS (SELECT pattern, min(line_no) AS first_line FROM d GROUP BY pattern)
SELECT CAST(d.line_no AS INTEGER) AS line_no, d.pattern, CAST(d.replacement_id AS INTEGER) AS replacement_id,
       CAST(CASE WHEN d.line_no = win.first_line THEN coalesce(h.n, 0) ELSE 0 END AS BIGINT) AS n_hits
FROM d JOIN win USING (pattern) LEFT JOIN h USING (pattern)"""

ORACLE["scan_summary"] = f"""WITH c AS (
  SELECT length(text) AS nc,
         len(list_filter(regexp_extract_all(text, {sql_str(D1_TOK)}), lambda x: x IN ({D1_IN}))) AS n
  FROM documents)
SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS n_changed,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS n_matches, CAST(coalesce(sum(nc), 0) AS BIGINT) AS n_chars
FROM c"""

ORACLE["resolve_replacement"] = f"""WITH {_token_rows('documents', 'doc_id', 'text', D1_TOK)},
m AS (SELECT * FROM w WHERE x IN ({D1_IN}))
SELECT doc_id,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal,
       CAST({D1_ID_CASE} AS INTEGER) AS replacement_id,
       {D1_REPL_CASE} AS replacement
FROM m"""


# ---- dictionaries derived from the tables ------------------------------------

_VOCAB = r"""
bw AS (SELECT item_id, unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS word,
              generate_subscripts(regexp_split_to_array(text, '[^\p{L}]+'), 1) AS pos
       FROM benchmark),
bv AS (SELECT CAST(row_number() OVER (ORDER BY item_id, pos) - 1 AS INTEGER) AS line_no,
              word AS pattern, 'W' || CAST(length(word) AS VARCHAR) AS replacement
       FROM bw WHERE length(word) > 0),
rid AS (SELECT replacement, CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS INTEGER) AS replacement_id
        FROM bv GROUP BY replacement),
vocab AS (SELECT line_no, pattern, replacement, replacement_id FROM bv JOIN rid USING (replacement)),
nodes AS (SELECT substring(pattern, 1, i) AS prefix, replacement_id AS id, length(pattern) AS n
          FROM vocab, LATERAL (SELECT unnest(range(0, length(pattern) + 1)) AS i)),
pnodes AS (SELECT prefix, CAST(length(prefix) AS INTEGER) AS depth,
                  CASE WHEN length(prefix) > 0 THEN substring(prefix, 1, length(prefix) - 1) END AS parent,
                  list_sort(list_distinct(list(id))) AS ids, max(n) AS maxn
           FROM nodes GROUP BY prefix)"""

ORACLE["dict_ids"] = f"WITH {_VOCAB} SELECT line_no, pattern, replacement, replacement_id FROM vocab"
ORACLE["dict_prefix_nodes"] = f"WITH {_VOCAB} SELECT prefix, depth, parent, ids FROM pnodes"
ORACLE["dict_breadth"] = f"""WITH {_VOCAB},
kids AS (SELECT parent AS prefix, count(*) AS b FROM pnodes WHERE parent IS NOT NULL GROUP BY parent)
SELECT prefix, CAST(coalesce(b, 0) AS INTEGER) AS breadth FROM pnodes LEFT JOIN kids USING (prefix)"""
ORACLE["dict_depth"] = f"""WITH {_VOCAB}
SELECT prefix, CAST(maxn - length(prefix) AS INTEGER) AS depth_below FROM pnodes"""
ORACLE["dict_id_path"] = f"WITH {_VOCAB} SELECT prefix, depth FROM pnodes WHERE list_contains(ids, 3)"
ORACLE["dict_prefix_lookup"] = f"""WITH {_VOCAB}
SELECT prefix AS child, substring(prefix, 3, 1) AS next_char, ids FROM pnodes WHERE parent = 'th'"""
ORACLE["dict_lint"] = f"""WITH {_VOCAB},
firsts AS (SELECT pattern, arg_min(line_no, line_no) AS fl, arg_min(replacement, line_no) AS fr
           FROM vocab GROUP BY pattern),
dup AS (SELECT v.line_no, v.pattern, 'duplicate' AS issue,
               'of line ' || CAST(f.fl AS VARCHAR)
               || CASE WHEN v.replacement <> f.fr THEN ', other replacement' ELSE '' END AS detail
        FROM vocab v JOIN firsts f USING (pattern) WHERE v.line_no <> f.fl),
sh AS (SELECT a.pattern, arg_min(b.pattern, length(b.pattern)) AS by_p
       FROM firsts a JOIN firsts b ON a.pattern <> b.pattern AND starts_with(a.pattern, b.pattern)
       GROUP BY a.pattern)
SELECT line_no, pattern, issue, detail FROM dup
UNION ALL
SELECT f.fl AS line_no, sh.pattern, 'shadowed' AS issue, 'by ' || sh.by_p AS detail
FROM sh JOIN firsts f USING (pattern)"""


# ---- sources and sinks --------------------------------------------------------

def _file_rx(m: str) -> dict[str, str]:
    head = f"(?s)^[^{m}]*{m}"  # up to the first mark
    return {"pair": head + f"([^{m}]*){m}.[^{m}]*{m}(.[^{m}]*){m}",
            "no_sep": head + f"[^{m}]*{m}{m}",
            "empty_repl": head + f"[^{m}]*{m}.[^{m}]*{m}{m}[^{m}]*\\z"}


def _file_dict_sql(lines_sql: str, mark: str) -> str:
    rx = _file_rx(mark)
    pair = sql_str(rx["pair"])
    return f"""WITH l AS ({lines_sql}),
p AS (SELECT line_no, regexp_extract(line, {pair}, 1) AS pattern,
             regexp_extract(line, {pair}, 2) AS replacement
      FROM l WHERE regexp_matches(line, {pair})),
good AS (SELECT * FROM p WHERE length(pattern) > 0),
rid AS (SELECT replacement, CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS INTEGER) AS replacement_id
        FROM good GROUP BY replacement)
SELECT line_no, pattern, replacement, replacement_id FROM good JOIN rid USING (replacement)"""


def _part_lines_sql(mark: str) -> str:
    m = mark.replace("'", "''")
    return (f"SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS line_no, "
            f"p_type || ' {m}' || p_name || '{m} => {m}' || p_brand || '{m} ' || CAST(p_size AS VARCHAR) "
            f"AS line FROM part")


ORACLE["dict_load"] = _file_dict_sql(_part_lines_sql('"'), '"')
ORACLE["dict_load_grouping"] = _file_dict_sql(_part_lines_sql("'"), "'")

_RX = _file_rx('"')
ORACLE["dict_rejects"] = f"""WITH l AS (
  SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER) AS line_no,
         CASE event_type WHEN 'click' THEN props || ' ' || props
                         WHEN 'view' THEN '"" "' || event_type || '"'
                         WHEN 'error' THEN '"' || event_type || '""'
                         WHEN 'signup' THEN event_type
                         ELSE event_type || ' ' || props END AS line
  FROM events),
r AS (SELECT line_no, line,
        CASE WHEN strpos(line, '"') = 0 THEN 'no marks'
             WHEN NOT regexp_matches(line, {sql_str(_RX['pair'])})
                  AND regexp_matches(line, {sql_str(_RX['no_sep'])}) THEN 'no separator'
             WHEN NOT regexp_matches(line, {sql_str(_RX['pair'])})
                  AND regexp_matches(line, {sql_str(_RX['empty_repl'])}) THEN 'empty replacement'
             WHEN NOT regexp_matches(line, {sql_str(_RX['pair'])}) THEN 'no replacement'
             WHEN length(regexp_extract(line, {sql_str(_RX['pair'])}, 1)) = 0 THEN 'empty pattern'
        END AS reason FROM l)
SELECT line_no, line, reason FROM r WHERE reason IS NOT NULL"""

ORACLE["dict_saved"] = ORACLE["dict_ids"]

ORACLE["corpus_scan"] = """SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_bytes,
       CAST(length(text) + 1 AS BIGINT) AS n_chars FROM documents"""

ORACLE["decode_bom"] = """SELECT doc_id,
       CASE lang WHEN 'en' THEN 'UTF-8' WHEN 'fr' THEN 'UTF-16LE' WHEN 'de' THEN 'UTF-16BE'
                 ELSE 'UTF-8' END AS charset, text
FROM documents"""

ORACLE["rewrite_sink"] = f"SELECT * FROM ({ORACLE['replace_all']}) WHERE n_matches > 0"

ORACLE["log_sink"] = f"""WITH {_token_rows('documents', 'doc_id', 'text', D1_TOK)}
SELECT CAST(doc_id AS VARCHAR) || ':  ' || ({D1_REPL_CASE}) || ' <- ''' || x || '''' AS line
FROM w WHERE x IN ({D1_IN})"""


# ---- P3 alias, U1 union --------------------------------------------------------

AL_FIRST, _ = _first_lines([(p.replace("~", "{"), r) for p, r in fixtures.ALIAS_DICT])
AL_ALT = "|".join(_lit_rx(p) for p in sorted(AL_FIRST, key=lambda s: (len(s), s)))
AL_IN = ", ".join(sql_str(p) for p in AL_FIRST)
AL_ID_CASE = "CASE x " + " ".join(
    f"WHEN {sql_str(p)} THEN {v[2]}" for p, v in AL_FIRST.items()) + " END"

ORACLE["placeholder_alias"] = f"""WITH {_token_rows('events', 'event_id', 'props', f'(?s)(?:{AL_ALT})|.')},
m AS (SELECT * FROM w WHERE x IN ({AL_IN}))
SELECT event_id,
       CAST(row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS INTEGER) AS ordinal,
       CAST(st AS INTEGER) AS start, CAST(st + length(x) AS INTEGER) AS "end",
       CAST(length(x) AS INTEGER) AS length, x AS text,
       CAST({AL_ID_CASE} AS INTEGER) AS replacement_id
FROM m"""

ORACLE["corpus_union"] = f"""WITH u AS (
  SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, text FROM documents
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), text
            FROM conversations)
SELECT source, key,
       CAST(coalesce(len(list_filter(regexp_extract_all(text, {sql_str(D1_TOK)}),
                                     lambda x: x IN ({D1_IN}))), 0) AS INTEGER) AS n_matches
FROM u"""


# ---- M3-M6 ----------------------------------------------------------------------

ORACLE["contains_pairs"] = """SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b
ON length(b.text) > 0 AND contains(d.text, b.text)"""

# D2 passages: table-driven, so the oracle builds its regex from the table in SQL:
# shortest first, every character written as \x{hex}.
ORACLE["find_all_anchor"] = r"""WITH bp AS (
  SELECT item_id, text AS pattern,
         CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS line_no FROM benchmark),
firsts AS (SELECT pattern, min(line_no) AS fl FROM bp WHERE length(pattern) > 0 GROUP BY pattern),
rid AS (SELECT '[' || CAST(item_id AS VARCHAR) || ']' AS repl,
               CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS INTEGER) AS replacement_id
        FROM bp GROUP BY item_id),
pid AS (SELECT f.pattern, r.replacement_id FROM firsts f JOIN bp ON bp.line_no = f.fl
        JOIN rid r ON r.repl = '[' || CAST(bp.item_id AS VARCHAR) || ']'),
rx AS (SELECT '(?s)(?:' || string_agg(
          array_to_string(list_transform(string_split(pattern, ''),
                          lambda c: '\x{' || printf('%x', unicode(c)) || '}'), ''),
          '|' ORDER BY length(pattern), pattern) || ')|.' AS r FROM firsts),
t AS (SELECT doc_id, regexp_extract_all(text, (SELECT r FROM rx)) AS tok FROM documents),
u AS (SELECT doc_id, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM t),
w AS (SELECT doc_id, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(x) AS st FROM u),
m AS (SELECT w.*, pid.replacement_id FROM w JOIN pid ON w.x = pid.pattern)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal,
       CAST(st AS INTEGER) AS start, CAST(st + length(x) AS INTEGER) AS "end",
       CAST(length(x) AS INTEGER) AS length, x AS text, replacement_id
FROM m"""

ORACLE["resolve_overlaps"] = ORACLE["find_all"]

# D3 written by hand in the shared regex subset (lazy quantifiers,
# '.' matching newline), in line order.
D3_RX = [r"[0-9]+?%", r"th[a-e]n", r"h[a-c]+?n", r"L(?s:.)cense"]
D3_ALT = "|".join(f"(?:{r})" for r in D3_RX)
D3_LINE = "CASE " + " ".join(
    f"WHEN regexp_full_match(x, {sql_str(r)}) THEN {i}" for i, r in enumerate(D3_RX)) + " END"
ORACLE["find_all_regex"] = f"""WITH {_token_rows('documents', 'doc_id', 'text', f'(?s)(?:{D3_ALT})|.')},
m AS (SELECT * FROM w WHERE regexp_full_match(x, {sql_str('(?s)(?:' + D3_ALT + ')')}))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal,
       CAST(st AS INTEGER) AS start, CAST(st + length(x) AS INTEGER) AS "end",
       CAST(length(x) AS INTEGER) AS length, x AS text, CAST({D3_LINE} AS INTEGER) AS line_no
FROM m"""

ORACLE["incremental_scan"] = ORACLE["find_all"]

# the word dictionary: regex built in SQL from the table (shortest first, first line per word)
ORACLE["find_all_auto"] = f"""WITH {_VOCAB},
firsts AS (SELECT pattern, arg_min(replacement_id, line_no) AS rid FROM vocab GROUP BY pattern),
rx AS (SELECT '(?s)(?:' || string_agg(
          array_to_string(list_transform(string_split(pattern, ''),
                          lambda c: '\\x{{' || printf('%x', unicode(c)) || '}}'), ''),
          '|' ORDER BY length(pattern), pattern) || ')|.' AS r FROM firsts),
t AS (SELECT doc_id, regexp_extract_all(text, (SELECT r FROM rx)) AS tok FROM documents),
u AS (SELECT doc_id, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM t),
w AS (SELECT doc_id, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(x) AS st FROM u),
m AS (SELECT w.*, firsts.rid FROM w JOIN firsts ON w.x = firsts.pattern)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal,
       CAST(st AS INTEGER) AS start, CAST(st + length(x) AS INTEGER) AS "end",
       CAST(length(x) AS INTEGER) AS length, x AS text, CAST(rid AS INTEGER) AS replacement_id
FROM m"""

# lines whose fourth character is any: regexes built in SQL, in line order
ORACLE["find_all_regex_large"] = f"""WITH {_VOCAB},
lines AS (SELECT line_no, array_to_string(list_transform(string_split(pattern, ''),
              lambda c, i: CASE WHEN i = 4 THEN '(?s:.)' ELSE '\\x{{' || printf('%x', unicode(c)) || '}}' END), '') AS rx
          FROM vocab WHERE length(pattern) >= 9),
rx AS (SELECT '(?s)(?:' || string_agg(rx, '|' ORDER BY line_no) || ')|.' AS r FROM lines),
t AS (SELECT doc_id, regexp_extract_all(text, (SELECT r FROM rx)) AS tok FROM documents),
u AS (SELECT doc_id, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM t),
w AS (SELECT doc_id, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(x) AS st FROM u),
h AS (SELECT x, min(line_no) AS line_no
      FROM (SELECT DISTINCT x FROM w WHERE length(x) > 1) JOIN lines ON regexp_full_match(x, rx) GROUP BY x)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal,
       CAST(st AS INTEGER) AS start, CAST(st + length(x) AS INTEGER) AS "end",
       CAST(length(x) AS INTEGER) AS length, x AS text, line_no
FROM w JOIN h USING (x)"""

ORACLE["replace_all_large"] = f"""WITH {_VOCAB},
firsts AS (SELECT pattern, arg_min(replacement, line_no) AS rep FROM vocab GROUP BY pattern),
rx AS (SELECT '(?s)(?:' || string_agg(
          array_to_string(list_transform(string_split(pattern, ''),
                          lambda c: '\\x{{' || printf('%x', unicode(c)) || '}}'), ''),
          '|' ORDER BY length(pattern), pattern) || ')|.' AS r FROM firsts),
t AS (SELECT doc_id, regexp_extract_all(text, (SELECT r FROM rx)) AS tok FROM documents),
u AS (SELECT doc_id, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM t)
SELECT doc_id, string_agg(coalesce(f.rep, x), '' ORDER BY i) AS text, CAST(count(f.pattern) AS INTEGER) AS n_matches
FROM u LEFT JOIN firsts f ON u.x = f.pattern GROUP BY doc_id"""

_D1_TEXT = _rewrite_sql(D1_REPL_CASE)
ORACLE["files_rewritten"] = f"""WITH r AS ({_D1_TEXT}),
c AS (SELECT r.doc_id, r.text, r.n_matches,
             CASE lang WHEN 'fr' THEN 'UTF-16LE' WHEN 'de' THEN 'UTF-16BE' ELSE 'UTF-8' END AS charset,
             CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 0 END AS mark
      FROM r JOIN documents USING (doc_id) WHERE r.n_matches > 0)
SELECT doc_id, charset, text, n_matches,
       CAST(mark + CASE WHEN charset = 'UTF-8' THEN strlen(text)
                        ELSE 2 * length(text) + 2 * len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10ffff}}]')) END
            AS INTEGER) AS n_bytes
FROM c"""

ORACLE["line_scan"] = f"""WITH lines AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id, j) - 1 AS BIGINT) AS line_no, line AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents)),
{_token_rows('lines', 'line_no', 'text', D1_TOK)},
m AS (SELECT * FROM w WHERE x IN ({D1_IN}))
SELECT line_no,
       CAST(row_number() OVER (PARTITION BY line_no ORDER BY i) - 1 AS INTEGER) AS ordinal,
       CAST(st AS INTEGER) AS start, CAST(st + length(x) AS INTEGER) AS "end",
       CAST(length(x) AS INTEGER) AS length, x AS text,
       CAST({D1_ID_CASE} AS INTEGER) AS replacement_id
FROM m"""

# other routes to the same results
ORACLE["find_all_walk_large"] = ORACLE["find_all_walk"]
ORACLE["replace_line_break_large"] = ORACLE["replace_line_break"]
ORACLE["scan_summary_large"] = ORACLE["scan_summary"]
ORACLE["docs_matching_large"] = ORACLE["docs_matching"]
ORACLE["incremental_scan_large"] = ORACLE["find_all"]
ORACLE["dict_branching"] = f"""WITH {_VOCAB},
kids AS (SELECT parent AS prefix, count(*) AS n FROM pnodes WHERE parent IS NOT NULL GROUP BY parent),
ends AS (SELECT DISTINCT pattern AS prefix FROM vocab)
SELECT p.prefix, p.depth, CAST(len(p.ids) AS BIGINT) AS n_ids
FROM pnodes p JOIN kids k USING (prefix) LEFT JOIN ends e ON e.prefix = p.prefix
WHERE k.n + CASE WHEN e.prefix IS NULL THEN 0 ELSE 1 END >= 2 OR p.depth = 0"""
