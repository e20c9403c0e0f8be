"""Compile a (small, size-checked) dictionary into regular expressions.

The regexes are consumed by Spark's JVM regex functions (``regexp_extract_all``,
``split``, ``rlike``) and, unchanged, by RE2 in DuckDB for the oracle, so only
the syntax both engines share is emitted: ``(?:..)``, ``|``, ``[^..]``, ``\\z``,
``\\x{hex}`` escapes, ``(?s)`` and the lazy quantifiers ``+?`` / ``*?``.

Three shapes are produced:

* ``retry_regex``: the prefix-factored alternation of the unshadowed patterns.
  Scanning it with ``find`` yields every leftmost non-overlapping match; with
  shadowed patterns removed at most one pattern can start at a position, so the
  first terminal reached is the only one (leftmost-shortest).
* ``walk_regex``: the trie itself as nested groups. Every token it extracts is a
  full pattern (a match), or all walks from the root up to the next match: runs of
  characters that start no pattern, failed walks that end with the mismatching
  character (which is consumed, not retried), and an unfinished walk at the end of
  the text. The tokens are contiguous and cover the text.
* ``translate_pattern``: a pattern of the small regex dialect (``.``, ``[a-b]``,
  ``[^..]``, ``\\x``, ``+``, ``*``, groups) rewritten with lazy quantifiers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

_END = None  # key marking "a pattern ends here" in the nested-dict trie


def atom(ch: str) -> str:
    """One code point as a regex atom valid in Java and RE2."""
    if ch.isascii() and ch.isalnum():
        return ch
    return "\\x{%x}" % ord(ch)


def literal(text: str) -> str:
    return "".join(atom(c) for c in text)


def negated_class(chars: Iterable[str]) -> str:
    return "[^" + "".join(atom(c) for c in sorted(set(chars))) + "]"


def build_trie(patterns: Iterable[str]) -> dict:
    root: dict = {}
    for p in patterns:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[_END] = True
    return root


def _children(node: dict) -> list[tuple[str, dict]]:
    return sorted((c, n) for c, n in node.items() if c is not _END)


def retry_regex(patterns: Sequence[str]) -> str | None:
    """Prefix-factored alternation of unshadowed, distinct patterns.

    Returns None for an empty dictionary (nothing can match). Chains of
    single-child nodes are emitted as plain literals, so nesting depth equals
    the number of branch points, not the pattern length.
    """
    pats = [p for p in patterns if p]
    if not pats:
        return None
    root = build_trie(pats)

    def chain(node: dict) -> tuple[str, dict]:
        """The literal from ``node`` to its next branch point or pattern end, and that node."""
        out = []
        while _END not in node:
            kids = _children(node)
            if len(kids) != 1:
                break
            out.append(atom(kids[0][0]))
            node = kids[0][1]
        return "".join(out), node

    # an explicit stack, so that any number of nested branch points will do
    out, stack = [], [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        literal_part, node = chain(item)
        out.append(literal_part)
        if _END in node:
            continue
        todo: list = ["(?:"]
        for k, (c, n) in enumerate(_children(node)):
            todo += [("|" if k else "") + atom(c), n]
        stack.extend(reversed([*todo, ")"]))
    return "".join(out)


def walk_regex(patterns: Sequence[str]) -> str | None:
    """Nested trie regex reproducing the byte walk that never retries.

    Every position of the text is covered by exactly one token: a match, or all
    walks without one up to the next match. Built with an explicit stack so deep
    patterns do not exhaust Python's recursion limit.
    """
    pats = [p for p in patterns if p]
    if not pats:
        return None
    root = build_trie(pats)

    # post-order: for each node below the root, how a walk goes on that reaches a
    # pattern's end, and how one that does not (None at a pattern's end: there is none)
    memo: dict[int, tuple[str, str | None]] = {}
    stack: list[tuple[dict, bool]] = [(n, False) for _, n in _children(root)]
    while stack:
        node, done = stack.pop()
        if _END in node:
            memo[id(node)] = ("", None)
            continue
        kids = _children(node)
        if not done:
            stack.append((node, True))
            stack.extend((n, False) for _, n in kids)
            continue
        hits = [atom(c) + memo[id(n)][0] for c, n in kids]
        fails = [atom(c) + memo[id(n)][1] for c, n in kids if memo[id(n)][1] is not None]
        fails += [negated_class(c for c, _ in kids), "\\z"]
        memo[id(node)] = ("(?:" + "|".join(hits) + ")", "(?:" + "|".join(fails) + ")")

    kids = _children(root)
    fails = [negated_class(c for c, _ in kids) + "++"]
    fails += [atom(c) + memo[id(n)][1] for c, n in kids if memo[id(n)][1] is not None]
    return "|".join(["(?:" + "|".join(fails) + ")++", *[atom(c) + memo[id(n)][0] for c, n in kids]])


class RegexDialectError(ValueError):
    """A dictionary pattern uses syntax the regex dialect does not support."""


@dataclass
class Item:
    """One item of a pattern: a set of characters or a group, and its quantifier (``''``, ``+`` or ``*``).

    ``chars`` are the set's characters if they are few and known; ``atom`` is its regex.
    """

    atom: str = ""
    chars: tuple[str, ...] | None = None
    group: list["Item"] | None = None
    quantifier: str = ""


MAX_SET = 16  # characters of a set that are spelt out


def _character_class(src: str, i: int) -> tuple[Item, int]:
    """The class that opens at ``src[i]``, and the index behind it."""
    j, n = i + 1, len(src)
    negate = j < n and src[j] == "^"
    j += negate
    ranges: list[tuple[str, str]] = []

    def one(j: int) -> tuple[str, int]:
        if src[j] == "\\" and j + 1 < n:
            return src[j + 1], j + 2
        return src[j], j + 1

    while j < n and src[j] != "]":
        low, j = one(j)
        high = low
        if j + 1 < n and src[j] == "-" and src[j + 1] != "]":
            high, j = one(j + 1)
            if ord(high) < ord(low):
                raise RegexDialectError(f"empty range {low}-{high}")
        ranges.append((low, high))
    if j >= n:
        raise RegexDialectError("unclosed class")
    if not ranges:
        raise RegexDialectError("empty class")
    inside = "".join(atom(a) if a == b else atom(a) + "-" + atom(b) for a, b in ranges)
    chars = None
    if not negate and sum(ord(b) - ord(a) + 1 for a, b in ranges) <= MAX_SET:
        chars = tuple(sorted({chr(c) for a, b in ranges for c in range(ord(a), ord(b) + 1)}))
    return Item("[" + ("^" if negate else "") + inside + "]", chars), j + 1


def pattern_items(src: str) -> list[Item]:
    """The items of one regex-dictionary pattern.

    Dialect: ``.`` any character including newline; ``[a-b]`` inclusive ranges,
    ``[abc]``, ``[^..]`` (``^`` only right after ``[``), ``[`` literal inside a
    class; ``]`` outside a class is literal; ``\\c`` takes ``c`` literally;
    ``+`` and ``*`` repeat the previous item lazily (matching stops at the first
    terminal); ``(`` ``)`` group. Anything else raises ``RegexDialectError``.
    """
    top: list[Item] = []
    stack, i = [top], 0
    free = False  # may a quantifier follow?
    while i < len(src):
        c, here = src[i], stack[-1]
        i += 1
        if c in "+*":
            if not free:
                raise RegexDialectError(f"quantifier {c} without atom")
            here[-1].quantifier = c
            free = False
            continue
        if c == "(":
            here.append(Item(group=[]))
            stack.append(here[-1].group)
            free = False
            continue
        if c == ")":
            if len(stack) == 1:
                raise RegexDialectError("unbalanced )")
            stack.pop()
        elif c == "^":
            raise RegexDialectError("^ outside a class")
        elif c == "[":
            item, i = _character_class(src, i - 1)
            here.append(item)
        elif c == ".":
            here.append(Item("(?s:.)"))
        else:
            if c == "\\":
                if i == len(src):
                    raise RegexDialectError("dangling escape")
                c, i = src[i], i + 1
            here.append(Item(atom(c), (c,)))
        free = True
    if len(stack) > 1:
        raise RegexDialectError("unbalanced (")
    if not top:
        raise RegexDialectError("empty pattern")
    return top


def items_regex(items: Sequence[Item]) -> str:
    return "".join((i.atom if i.group is None else "(?:" + items_regex(i.group) + ")")
                   + (i.quantifier + "?" if i.quantifier else "") for i in items)


def translate_pattern(src: str) -> str:
    """One regex-dictionary pattern (see ``pattern_items``) in the shared Java/RE2 subset."""
    return items_regex(pattern_items(src))


def can_be_empty(items: Sequence[Item]) -> bool:
    """Whether a pattern matches the empty text."""
    return all(i.quantifier == "*" or (i.group is not None and can_be_empty(i.group)) for i in items)


MAX_TEXTS = 64  # texts of one factor


def placed_factors(items: Sequence[Item]) -> list[tuple[list[str], int, int]]:
    """What every text that matches contains: of each factor, one of its texts, and where.

    Neighbouring sets of known characters are spelt out together, as far as a
    factor has at most ``MAX_TEXTS`` texts, all of one length. Factors with the same
    first number stand at the distance of their second numbers, in every match;
    a repeated item starts a new first number.
    """
    out: list[tuple[list[str], int, int]] = []
    run, begin = [""], 0
    part = at = 0

    def close() -> None:
        nonlocal run, begin
        if run != [""]:
            out.append((run, part, begin))
        run, begin = [""], at

    def new_part() -> None:
        nonlocal part, at, begin
        close()
        part, at, begin = part + 1, 0, 0

    def go(items: Sequence[Item]) -> None:
        nonlocal run, at
        for i in items:
            if i.quantifier == "*":
                new_part()
            elif i.group is not None:
                go(i.group)
                if i.quantifier == "+":
                    new_part()
            elif i.chars is None:
                close()
                if i.quantifier == "+":
                    new_part()
                else:
                    at += 1
                    close()
            else:
                if len(run) * len(i.chars) > MAX_TEXTS:
                    close()
                run = [r + c for r in run for c in i.chars]
                at += 1
                if i.quantifier == "+":  # the last of the repeated characters stands before what follows
                    new_part()
                    run, at = list(i.chars), 1
    go(items)
    close()
    return out


def factors(items: Sequence[Item]) -> list[list[str]]:
    """The texts of ``placed_factors``."""
    return [texts for texts, _, _ in placed_factors(items)]


def ordered_alternation(translated: Sequence[str]) -> str | None:
    """Alternation in dictionary line order: ties at one start go to the earlier line."""
    if not translated:
        return None
    return "|".join("(?:" + t + ")" for t in translated)
