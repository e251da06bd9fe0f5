"""Licence scans: Dice coefficient over word bigrams against licence templates.

Lines, paragraphs (between blank lines) and whole texts are compared, with whole templates and
with the paragraphs of templates that have several.  Normalised text is
words of letters and digits in lower case; the coefficient counts bigrams as multisets.  A
unit of n bigrams can only reach the threshold t with templates of at least n·t/(2-t) and at
most n·(2-t)/t bigrams, so the length alone prunes most units; others are compared with the
templates they share bigrams with.  All work is done by built-in functions.

Null and empty texts and units of one word have no bigrams and no hits.  Very long texts are
read whole.  Rows that repeat a doc_id are one document, a null doc_id among them.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and short licence texts as their owners publish them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "bsd-3-clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "bsd-2-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def bigram_counts(text: str) -> Counter[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def with_parts(templates: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Templates of several paragraphs also by paragraph (of ten words or more): published texts stand so in longer documents."""
    parts = lambda t: [p for p in t.split("\n\n") if p != t and len(p.split()) >= 10]
    return {name: tuple(dict.fromkeys([*texts, *(p for t in texts for p in parts(t))])) for name, texts in templates.items()}


def template_table(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, int, int, str, int]]:
    """(license, template, size in bigrams, bigram, count): as many rows as the templates have bigrams."""
    out = []
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            counts = bigram_counts(text)
            out += [(name, k, sum(counts.values()), b, n) for b, n in counts.items()]
    return out


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, level, at, words) of lines, and of paragraphs and whole texts where they are more than a line."""
    text = F.col("text").cast("string")
    lines, parts = F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n")

    def each(level: str, texts: Column) -> Column:
        return F.transform(texts, lambda t, i: F.struct(F.lit(level).alias("level"), i.alias("at"), t.alias("unit")))

    none = F.array().cast("array<struct<level:string,at:int,unit:string>>")
    every = F.concat(each("line", lines), F.when(F.size(parts) > 1, each("paragraph", parts)).otherwise(none), F.when(F.size(lines) > 1, each("text", F.array(text))).otherwise(none))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(every).alias("u"))
    return out.select("doc_id", "u.level", "u.at", once(words_of(F.col("u.unit"))).alias("words"))


def once(value: Column) -> Column:
    """A generated column: filters on it are not pushed below it, where they would compute it again."""
    return F.explode(F.array(value))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8) -> DataFrame:
    """Units of ``docs`` (doc_id, text) that match a template: doc_id, level, at, license, dice.

    Of a licence's templates the best one counts.
    """
    spark = docs.sparkSession
    rows = template_table(with_parts(TEMPLATES if templates is None else templates))
    values = ", ".join(f"('{a}', {k}, {size}L, '{b}', {n}L)" for a, k, size, b, n in rows) or "('', 0, 1L, '', 0L)"
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(license, template, size, bigram, has)")
    sizes = [r[2] for r in rows] or [1]
    known = sorted({r[3] for r in rows})
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    n = F.size("words") - 1
    fit = units(docs).where((n >= min(sizes) * least) & (n <= max(sizes) * most))
    two = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat_ws(" ", a, b))
    # What a unit shares with any template at all; few units share enough for the smallest one.
    shared = F.filter(two, lambda b: b.isin(known))
    fit = fit.select("doc_id", "level", "at", n.cast("long").alias("n"), once(shared).alias("shared")).where(F.size("shared") >= min(sizes) * least)
    # A number for each unit, so that repeated rows stay apart.
    fit = fit.withColumn("unit", F.monotonically_increasing_id())
    counts = fit.select("unit", "doc_id", "level", "at", "n", F.explode("shared").alias("bigram"))
    counts = counts.groupBy("unit", "doc_id", "level", "at", "n", "bigram").agg(F.count("*").alias("has_unit"))
    size = F.col("size")
    hits = counts.join(F.broadcast(table), "bigram").where((F.col("n") >= size * least) & (F.col("n") <= size * most))
    hits = hits.groupBy("unit", "doc_id", "level", "at", "n", "license", "template", "size").agg(F.sum(F.least("has_unit", "has")).alias("both"))
    hits = hits.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + size)).where(F.col("dice") >= threshold)
    return hits.groupBy("unit", "doc_id", "level", "at", "license").agg(F.max("dice").alias("dice")).drop("unit")


def licenses(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, license, dice, lines): the licences of each document, with the best match and how many lines match."""
    lines = F.sum(F.when(F.col("level") == "line", 1).otherwise(0)).alias("n_lines")
    return scan(docs, None, threshold).groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), lines)


def sql(threshold: float = 0.8) -> str:
    """The same report in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {k}, {quoted(t)})" for a, texts in with_parts(TEMPLATES).items() for k, t in enumerate(texts))
    words = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    pairs = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    return f"""
WITH templates(license, template, text) AS (VALUES {values}),
t AS (SELECT license, template, {words.format('text')} AS w FROM templates),
tb AS (SELECT license, template, len(w) - 1 AS size, unnest({pairs.format('w')}) AS bigram FROM t),
tc AS (SELECT license, template, size, bigram, count(*) AS has FROM tb GROUP BY ALL),
units AS (
  SELECT doc_id, 'line' AS level, unnest(string_split(text, chr(10))) AS unit FROM documents
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n')
  UNION ALL
  SELECT doc_id, 'text', text FROM documents WHERE contains(text, chr(10))
),
u AS (SELECT row_number() OVER () AS id, doc_id, level, {words.format('unit')} AS w FROM units),
ub AS (SELECT id, doc_id, level, len(w) - 1 AS n, unnest({pairs.format('w')}) AS bigram FROM u WHERE len(w) > 1),
uc AS (SELECT id, doc_id, level, n, bigram, count(*) AS has FROM ub GROUP BY ALL),
d AS (
  SELECT id, doc_id, level, license, template, 2.0::DOUBLE * sum(least(uc.has, tc.has)) / (n + size) AS dice
  FROM uc JOIN tc USING (bigram) GROUP BY id, doc_id, level, n, license, template, size
),
b AS (SELECT id, doc_id, level, license, max(dice) AS dice FROM d WHERE dice >= {threshold} GROUP BY ALL)
SELECT doc_id, license, max(dice) AS dice, count(*) FILTER (level = 'line') AS n_lines FROM b GROUP BY doc_id, license
"""
