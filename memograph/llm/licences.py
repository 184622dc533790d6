"""Licence scans by canonical digests, in DataFrame functions only.

Texts are brought to a canonical form: lower case, no copyright lines, one spelling of equivalent words, words alone.
The digest of a whole canonical text, and of each of its lines, is joined by hash to the digests of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known tables of at most so many rows are sent to all tasks; larger ones are joined by a shuffle.
FEW_KNOWN = 100_000
COPYRIGHT = r"^[^a-z0-9]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\])"
MARKS = r"[\x01-\x09\x0B-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F‘’“”–—•·©«»]+"
#: Equivalent spellings in licences, the second counts.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licensable", "sublicensable"),
    ("https", "http"), ("favour", "favor"), ("organisation", "organization"), ("judgement", "judgment"), ("whilst", "while"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("behaviour", "behavior"), ("centre", "center"), ("fulfilment", "fulfillment"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("v1", "version 1"), ("v2", "version 2"), ("v3", "version 3"), ("ver", "version"), ("gnu gpl", "gnu general public license"),
]
#: Names and short texts of public licences.
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Revised BSD License"],
    "ISC": ["ISC License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"], "EPL-2.0": ["Eclipse Public License, version 2.0"],
    "BSL-1.0": ["Boost Software License, version 1.0"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
}
LEADS = [
    "", "Licensed under", "Released under", "Distributed under", "Available under", "Published under", "This work is licensed under",
    "This file is licensed under", "This software is licensed under", "This project is licensed under", "This document is licensed under",
    "License:", "SPDX-License-Identifier:",
]
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}


def known_texts() -> list[tuple[str, str]]:
    """Licence ids with the texts that stand for them: notices made of leads and names, ids, and whole short licences."""
    made = [(licence, f"{lead} {article}{name}") for licence, names in NAMES.items() for name in [*names, licence] for lead in LEADS for article in ("", "the ")]
    return made + list(TEXTS.items()) + [("MIT", f"MIT License\n\nCopyright (c) [year] [fullname]\n\n{TEXTS['MIT']}")]


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, those without words left out."""
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda line: ~line.rlike(COPYRIGHT))
    words = F.transform(lines, lambda line: F.btrim(F.regexp_replace(F.regexp_replace(line, MARKS, " "), " {2,}", " ")))
    return F.transform(F.filter(words, lambda line: line != ""), _respelled)


def _respelled(line: Column) -> Column:
    """Words of a line in their counting spelling; lines that hold none of the others stay as they are."""
    odd = line.contains(SPELLINGS[0][0])
    for spelling, _ in SPELLINGS[1:]:
        # Three letters may well be inside other words.
        odd = odd | (line.contains(spelling) if spelling != "ver" else line.contains(" ver") | line.startswith("ver"))
    made = F.concat(F.lit("  "), F.replace(line, F.lit(" "), F.lit("  ")), F.lit("  "))
    for spelling, other in SPELLINGS:
        made = F.replace(made, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {other.replace(' ', '  ')} "))
    return F.when(odd, F.btrim(F.regexp_replace(made, " +", " "))).otherwise(line)


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """license_id and digest of known texts; one id per digest, the smallest."""
    if not isinstance(texts, DataFrame):
        texts = spark.createDataFrame(known_texts() if texts is None else texts, "license_id string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return texts.select("license_id", whole.alias("whole")).filter("whole != ''").groupBy(digest(F.col("whole")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Known licences found: doc_id, license_id, scope (``text``: the whole document, ``line``: one of its lines), n.

    A document of one line is reported under both scopes. Documents without any, null and empty ones give no row; n
    counts over all rows of a doc_id, rows without an id together. Extra columns play no part.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text").cast("string")).alias("lines"))
    whole = F.struct(F.lit("text").alias("scope"), digest(F.array_join("lines", " ")).alias("digest"))
    each = F.transform("lines", lambda line: F.struct(F.lit("line").alias("scope"), digest(line).alias("digest")))
    found = lines.filter(F.size("lines") > 0).select("doc_id", F.explode(F.concat(F.array(whole), each)).alias("unit"))
    few = F.broadcast(known) if known.count() <= FEW_KNOWN else known
    units = found.select("doc_id", "unit.scope", "unit.digest")
    return units.join(few, "digest").groupBy("doc_id", "license_id", "scope").agg(F.count("*").alias("n"))


def _sql_canonical(line: str) -> str:
    made = f"'  ' || replace(regexp_replace(regexp_replace({line}, '{MARKS}', ' ', 'g'), ' +', ' ', 'g'), ' ', '  ') || '  '"
    for spelling, other in SPELLINGS:
        made = f"replace({made}, ' {spelling.replace(' ', '  ')} ', ' {other.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({made}, ' +', ' ', 'g'))"


def oracle_sql() -> str:
    """The same scan of ``documents`` in SQL."""
    quoted = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known_texts())
    lines = "list_filter(string_split(lower(coalesce(text, '')), chr(10)), lambda x: NOT regexp_matches(x, '{}'))".format(COPYRIGHT)
    canon = f"list_filter(list_transform({lines}, lambda x: {_sql_canonical('x')}), lambda x: x <> '')"
    return f"""
WITH texts(license_id, text) AS (VALUES {quoted}),
known AS (
    SELECT sha256(array_to_string(lines, ' ')) AS digest, min(license_id) AS license_id
    FROM (SELECT license_id, {canon} AS lines FROM texts) WHERE len(lines) > 0 GROUP BY 1
),
docs AS (SELECT doc_id, {canon} AS lines FROM documents),
units AS (
    SELECT doc_id, 'text' AS scope, sha256(array_to_string(lines, ' ')) AS digest FROM docs WHERE len(lines) > 0
    UNION ALL SELECT doc_id, 'line', sha256(line) FROM (SELECT doc_id, unnest(lines) AS line FROM docs)
)
SELECT doc_id, license_id, scope, count(*) AS n FROM units JOIN known USING (digest) GROUP BY ALL
"""
