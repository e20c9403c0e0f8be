"""Licence scan with DataFrame functions only.

Headers and licence files are compared with templates by the cosine of sparse
TF-IDF vectors: term rows join the templates' postings. Compared are, of every
file, its lines, its windows of up to ``WINDOW`` consecutive lines that begin and end
with a line that has a marked term (a header wrapped anyhow), and its sentences (a notice inside a paragraph; a sentence may go over
lines and ends at an empty one), each with ``NOTICES``, among them the titles that
full licence texts begin with; and the whole text of files named like a licence,
with ``TEXTS`` too. A file without a licence of its own inherits that of the licence
file in its nearest ancestor directory, found by joining the path's ancestors.

Inverse document frequencies are those of the template collection (fixed, and
bounded by it), so that a file's score does not change with the files around it; a
term of no template weighs as one of no document. A vector within ``THRESHOLD`` of a
template must share one of its *prefix* terms, which are the marked ones: those without
which the rest of the template is shorter than the threshold; and enough terms of it to reach the
threshold at all, and not so many terms of no template that they alone keep the
cosine below it; other units are left out before any row is made. No match is lost by
that.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

THRESHOLD = 0.7
DIGITS = 9  # scores are rounded before they are compared, so that ties are ties
WINDOW = 8  # lines of a header
SENTENCE_END = r"[.!?][ \t\r\n]+|\n[^a-z0-9\n]*\n"
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"

# the most frequent English words
COMMON = frozenset("a an and are as at be by for from in is it of on or that the this to was with you".split())

# Usual notices and the titles of licence texts, by SPDX-style name.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
                   "in compliance with the License."),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License, Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License, Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License, Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License, Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)
_AS_IS = ("WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
          "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
          "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
          "THE SOFTWARE.")
# Whole texts of short licences.
TEXTS = (
    ("MIT", "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
            "do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
            + _AS_IS),
    ("BSD-3-Clause", "Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met: Redistributions of "
                     "source code must retain the above copyright notice, this list of conditions and the following "
                     "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided with "
                     "the distribution. Neither the name of the copyright holder nor the names of its contributors may be "
                     "used to endorse or promote products derived from this software without specific prior written "
                     "permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
                     "EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
                     "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."),
)
TEMPLATES = NOTICES + TEXTS


def _terms(text: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", text.lower()))


def template_vectors(templates=TEMPLATES):
    """Per template its (term, unit weight) pairs; the idf of every term; the idf of unseen terms."""
    counts = [_terms(t) for _, t in templates]
    seen = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in seen.items()}
    vectors = []
    for c in counts:
        w = {t: n * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors.append({t: x / norm for t, x in w.items()})
    return vectors, idf, math.log(1 + len(counts)) + 1


def prefix_terms(vectors, threshold: float) -> list[str]:
    """Terms of which a unit within the threshold of some template has at least one.

    Any order of the terms will do; common words are left out first, then the
    shortest, because they would let every line of running text through.
    """
    out = set()
    for v in vectors:
        rest = 0.0
        for t, w in sorted(v.items(), key=lambda x: (x[0] not in COMMON, len(x[0]), x[1], x[0])):
            rest += w * w
            if math.sqrt(rest) >= threshold - 1e-9:
                out.add(t)
    return sorted(out)


def terms_needed(vector, threshold: float) -> int:
    """How many of a template's terms a unit within the threshold shares with it at least.

    The cosine is at most the length of the template over the shared terms, so
    even the heaviest terms have to add up to the threshold.
    """
    total, n = 0.0, 0
    for w in sorted(vector.values(), reverse=True):
        if math.sqrt(total) >= threshold - 1e-9:
            break
        total, n = total + w * w, n + 1
    return n


def mark_regex(notices, threshold: float) -> str:
    """A marked term, bounded as terms are: an underscore ends a term."""
    return "(?:^|[^a-z0-9])(?:" + "|".join(prefix_terms(notices, threshold)) + ")(?:[^a-z0-9]|$)"


def units_of(files: DataFrame, mark: str, window: int = WINDOW) -> DataFrame:
    """``id, path, copy, unit, whole, body``: what of every file is compared.

    Lines and windows of lines, and sentences, that hold a marked term; whole texts
    of licence files. ``copy`` tells rows of equal id and path apart by their text.
    """
    text = F.lower(F.col("text"))
    src = files.select("id", "path", F.xxhash64("text").alias("copy"), text.alias("body"), F.split(text, "\n").alias("lines"))
    whole = src.where(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_NAME)).select(
        "id", "path", "copy", F.lit(-1).cast("bigint").alias("unit"), F.lit(True).alias("whole"), "body")
    src = src.where(F.col("body").rlike(mark))
    marked = F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(mark), i)))
    src = src.select("id", "path", "copy", "body", "lines", marked.alias("marked"))
    windows = F.flatten(F.transform("marked", lambda s: F.transform(
        F.filter("marked", lambda e: (e >= s) & (e < s + window)),
        lambda e: F.struct((s.cast("bigint") * window + (e - s)).alias("unit"),
                           F.array_join(F.slice("lines", s + 1, e - s + 1), "\n").alias("body")))))
    sentences = F.filter(F.transform(F.split("body", SENTENCE_END), lambda x, i: F.struct(
        (-2 - i).cast("bigint").alias("unit"), x.alias("body"))), lambda u: u["body"].rlike(mark))
    parts = src.select("id", "path", "copy", F.inline(F.concat(windows, sentences)))
    return whole.unionByName(parts.select("id", "path", "copy", "unit", F.lit(False).alias("whole"), "body"))


def own_licenses(files: DataFrame, templates=TEMPLATES, texts: int = len(TEXTS),
                 threshold: float = THRESHOLD) -> DataFrame:
    """``id, path, own, score``: the best template of every file that has one.

    The last ``texts`` templates are whole texts, compared with whole licence files only.
    """
    spark = files.sparkSession
    vectors, idf, unseen = template_vectors(templates)
    notices = vectors[:len(vectors) - texts]
    idfs = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    postings = spark.createDataFrame(
        [(t, k, templates[k][0], k >= len(notices), w) for k, v in enumerate(vectors) for t, w in v.items()],
        "term string, template int, license string, text boolean, weight double")
    units = units_of(files, mark_regex(notices, threshold)).withColumn("terms", F.regexp_extract_all("body", F.lit("[a-z0-9]+"), F.lit(0)))
    # terms of no template weigh most; if they alone make a unit too long for the others, no cosine reaches the threshold
    known = F.filter("terms", lambda t: t.isin(sorted(idf)))
    squares = F.aggregate(F.transform(F.array_distinct("known"), lambda t: F.size(F.filter("known", lambda x: x == t))),
                          F.lit(0), lambda a, n: a + n * n)
    others = F.size(F.array_distinct("terms")) - F.size(F.array_distinct("known"))
    room = (1 / threshold ** 2 - 1 + 1e-6) * max(idf.values()) ** 2 / unseen ** 2
    units = units.withColumn("known", known).where(others <= squares * F.lit(room))
    enough = F.col("whole")
    for v in notices:
        shared = F.array_intersect("terms", F.array(*[F.lit(t) for t in sorted(v)]))
        enough = enough | (F.size(shared) >= terms_needed(v, threshold))
    key = ["id", "path", "copy", "unit"]
    terms = units.where(enough).select(*key, "whole", F.explode("terms").alias("term"))
    w = materialise(terms.groupBy(*key, "whole", "term").agg(F.count(F.lit(1)).alias("tf")), "license-terms")
    w = w.join(F.broadcast(idfs), "term", "left").withColumn(
        "w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))  # as many rows as template terms
    norm = w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = (w.join(F.broadcast(postings), "term").where("whole OR NOT text").groupBy(*key, "template", "license")
           .agg(F.sum(F.col("w") * F.col("weight")).alias("dot")))
    same = dot["id"].eqNullSafe(norm["id"]) & dot["path"].eqNullSafe(norm["path"]) & \
        (dot["unit"] == norm["unit"]) & (dot["copy"] == norm["copy"])
    hits = dot.join(norm, same).select(dot["id"], dot["path"], "license", F.round(F.col("dot") / F.col("norm"), DIGITS)
                                       .alias("score")).where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b")
    return hits.groupBy("id", "path").agg(best).select(
        "id", "path", F.col("b.license").alias("own"), (-F.col("b.less")).alias("score"))


def parent(path):
    """Directory of a path ('' at the top)."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text",
                 templates=TEMPLATES, texts: int = len(TEXTS), threshold: float = THRESHOLD) -> DataFrame:
    """``id, path, own, score, license, inherited_from`` for every row of ``files``.

    ``own`` is the licence of the best header, sentence or whole licence file with
    its cosine; ties go to the first licence name. ``license`` is ``own``, else that
    of the nearest ancestor directory with a recognised licence file (the
    smallest score loses, then licence name order), named in ``inherited_from``
    ('' is the top). Null texts have no licence of their own; a null path has no
    directory and inherits nothing; rows of equal id and path share the best of
    their texts; repeated rows are returned as often as they come; other columns
    are ignored; an empty table gives an empty result.
    """
    src = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    own = materialise(own_licenses(src, templates, texts, threshold), "licenses")
    name = F.element_at(F.split("path", "/"), -1)
    by_dir = (own.where(name.rlike(LICENSE_NAME)).groupBy(parent(F.col("path")).alias("ancestor"))
              .agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("own").alias("license"))).alias("b"))
              .select("ancestor", "b.license"))
    dirs = src.where("path IS NOT NULL").select(parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.size(parts)))).alias("depth"))
    chain = chain.withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = (chain.join(by_dir, "ancestor").groupBy("dir")
               .agg(F.max(F.struct("depth", "ancestor", "license")).alias("a"))
               .select("dir", F.col("a.ancestor").alias("from"), F.col("a.license").alias("theirs")))
    rows = src.select("id", "path", parent(F.col("path")).alias("at"))
    rows = rows.join(own.withColumnsRenamed({"id": "i", "path": "p"}),
                     F.col("id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")), "left")
    rows = rows.join(nearest, F.col("at") == F.col("dir"), "left")
    return rows.select("id", "path", "own", "score", F.coalesce("own", "theirs").alias("license"),
                       F.when(F.col("own").isNull(), F.col("from")).alias("inherited_from"))


def files_of(docs: DataFrame) -> DataFrame:
    """Stand-in file table: a path per document, by source, language and id; some named LICENSE."""
    i = F.col("doc_id")
    tail = (F.when(i % 1024 == 0, F.lit("LICENSE"))
            .when(i % 32 == 0, F.concat(F.floor(i / 1024).cast("string"), F.lit("/LICENSE")))
            .otherwise(F.concat(F.floor(i / 1024).cast("string"), F.lit("/"), F.floor(i / 32).cast("string"), F.lit("/"),
                                i.cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", tail).alias("path"), "text")


def op8(spark, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every document, as a file with a path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return license_scan(files_of(docs), "doc_id").withColumnRenamed("id", "doc_id").withColumn(
        "score", F.round("score", 6))


def _op8_sql() -> str:
    vectors, idf, unseen = template_vectors()
    quote = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
    return rf"""
WITH idf(term, idf) AS (VALUES {quote(sorted(idf.items()))}),
post(term, template, license, text, weight) AS (
  VALUES {quote([(t, k, TEMPLATES[k][0], k >= len(NOTICES), w) for k, v in enumerate(vectors) for t, w in v.items()])}),
files AS (
  SELECT doc_id, lower(text) AS body, concat_ws('/', source, lang,
    CASE WHEN doc_id % 1024 = 0 THEN 'LICENSE'
         WHEN doc_id % 32 = 0 THEN (doc_id // 1024) || '/LICENSE'
         ELSE (doc_id // 1024) || '/' || (doc_id // 32) || '/' || doc_id || '.txt' END) AS path FROM documents),
lines AS (SELECT doc_id, path, string_split(body, chr(10)) AS line, unnest(range(len(string_split(body, chr(10))))) AS s FROM files),
marked AS (SELECT doc_id, path, s FROM lines WHERE regexp_matches(line[s + 1], '{mark_regex(vectors[:len(NOTICES)], THRESHOLD)}')),
units AS (
  SELECT l.doc_id, l.path, array_to_string(l.line[l.s + 1:e.s + 1], chr(10)) AS body, l.s * {WINDOW} + e.s - l.s AS unit, false AS whole
  FROM lines l JOIN marked a ON a.doc_id = l.doc_id AND a.s = l.s
  JOIN marked e ON e.doc_id = l.doc_id AND e.s >= l.s AND e.s < l.s + {WINDOW}
  UNION ALL
  SELECT doc_id, path, unnest(regexp_split_to_array(body, '{SENTENCE_END}')) AS body,
         -2 - unnest(range(len(regexp_split_to_array(body, '{SENTENCE_END}')))) AS unit, false FROM files
  UNION ALL SELECT doc_id, path, body, -1, true FROM files WHERE path LIKE '%LICENSE'),
tf AS (SELECT doc_id, path, unit, whole, term, count(*) AS tf FROM (
         SELECT doc_id, path, unit, whole, unnest(regexp_extract_all(body, '[a-z0-9]+')) AS term FROM units) GROUP BY ALL),
w AS (SELECT tf.*, CAST(tf AS DOUBLE) * CAST(coalesce(idf, {unseen!r}) AS DOUBLE) AS w FROM tf LEFT JOIN idf USING (term)),
norm AS (SELECT doc_id, path, unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dot AS (SELECT doc_id, path, unit, template, license, sum(w * CAST(weight AS DOUBLE)) AS dot
        FROM w JOIN post USING (term) WHERE whole OR NOT text GROUP BY ALL),
hit AS (SELECT doc_id, path, license, round(dot / norm, {DIGITS}) AS score FROM dot JOIN norm USING (doc_id, path, unit)
        WHERE round(dot / norm, {DIGITS}) >= {THRESHOLD}),
own AS (SELECT doc_id, path, license AS own, score FROM hit
        QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, license) = 1),
at_dir AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, own, score FROM own WHERE path LIKE '%LICENSE'
           QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own) = 1),
place AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
near AS (SELECT p.doc_id, p.path, a.dir, a.own AS theirs FROM place p JOIN at_dir a
           ON p.dir = a.dir OR a.dir = '' OR starts_with(p.dir, a.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.path ORDER BY length(a.dir) DESC) = 1)
SELECT p.doc_id, p.path, o.own, round(o.score, 6) AS score, coalesce(o.own, n.theirs) AS license,
       CASE WHEN o.own IS NULL THEN n.dir END AS inherited_from
FROM place p LEFT JOIN own o ON o.doc_id = p.doc_id AND o.path = p.path
LEFT JOIN near n ON n.doc_id = p.doc_id AND n.path = p.path
"""


OP8_SQL = _op8_sql()
