"""Fixed inputs of the registered queries and tests.

Fixed values: the literal dictionary D1, the regex dictionary D3, the alias
dictionary used over ``events.props``, and the reference's manual fixture
(pattern file and search file). They are parameters of the queries, the
corpora the queries search are always the given tables.
"""

from __future__ import annotations

# D1, literal dictionary over `documents` (pattern, replacement), in line order.
D1 = [
    ("the", "THE"),
    ("tho", "THO"),
    ("and", "AND"),
    ("License", "LICENCE"),
    ("in a", "INA"),
    ("é", "E"),
    ("ou", "OU"),
    ("oué", "OUE"),
    ("the", "DUP"),
    ("ing", "AND"),
    ("onne", "ON"),
    ("ion", "ION"),
]

# D3, regex dictionary (pattern, replacement), in line order.
D3 = [
    ("[0-9]+%", "PCT"),
    ("th[a-e]n", "THN"),
    ("h[a-c]+n", "HN"),
    ("L.cense", "LIC"),
]

# Alias dictionary over `events.props` ('~' stands for '{').
ALIAS_DICT = [
    ('~"k": 1', "K1"),
    ('~"k": 2', "K2"),
    ('{"k": 3', "K3"),
    ('~"k": 3', "K3B"),
    ('"k": 9', "K9"),
]

# The reference's manual fixture (pattern file lines, UTF-8 with BOM).
SAMPLE_PATTERN_FILE = '﻿"test one" "replace one"\n"test two" "two replace"\n"abcdefg" "hijklmnop"'

# The reference's manual search file (116 bytes, LF, no final newline).
SAMPLE_SEARCH_TEXT = (
    "hijklmnop\njfdshfjhijklmnop\nskdfjhsdf\nasdsad\ns\n\ntestone replace one\n"
    "replace onetest one\nasds\na\nsf\nhijklmnopsfkdogkro "
)
