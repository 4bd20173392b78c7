"""License scans: TF-IDF cosine of lines, headers and licence files to templates, then inheritance from the nearest directory.

Files are rows of a path and a text. The units of a text are its lines, its header (the first paragraph, when it has several
lines) and, of a file named as a licence file, the whole text. A unit is a sparse vector of its words, weighted by one
plus the logarithm of their frequency and by the inverse document frequency of the word among the templates; templates are
licence texts, standard headers, notices and identifiers. A unit matches a template by a cosine of at least ``threshold``, with
at least two words in common.
A file's licence is that of the match with the highest cosine over all its units. A file named as a licence file, or whose header or
first line with words is a match, also licenses its directory. A file without a licence of its own takes that of its nearest
ancestor directory: paths are joined with the licensed directories, each ancestor a row.

Units that cannot reach the threshold go before they are taken apart: by Cauchy's inequality a unit without any of a template's
decisive words (see ``decisive``) has a cosine below it, and a second word of the template must be there, or for a template of many
words several decisive ones. No unit that could match is lost. Copies of a text are taken apart once. Everything is DataFrame functions; the templates are a fixed small set.

Defined results: null or empty text has no licence of its own; a null path has no directory and inherits nothing;
rows with equal path or id are files each on its own; ties go to the licence first in name order; directory ties go to
the higher score, then the name; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.tables import materialize

# Licence texts, headers, notices and titles by SPDX identifier.
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CLAUSES_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_THIRD_BSD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [_GPL.format(name="Affero General Public License", version="3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [f"{_CLAUSES_BSD} {_WARRANTY_BSD}", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [f"{_CLAUSES_BSD} {_THIRD_BSD} {_WARRANTY_BSD}", _CLAUSES_BSD, _THIRD_BSD, "Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "GPL-2.0": [_GPL.format(name="General Public License", version="2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": [_GPL.format(name="General Public License", version="3"), "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""", "ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": [_GPL.format(name="Lesser General Public License", version="3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
        "Released under the MIT License.", "The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "zlib License", "SPDX-License-Identifier: Zlib"],
}
# Words that plain text is full of: they and numbers are the last to be taken as decisive. The list only orders words; results don't depend on it.
COMMON = set("a all also an and any are as at be but by can do for free from get has have if in is it may more must no not of on one or other out people see so that the their they this to under use used was we were will with without work you your".split())
LONG = 14
THRESHOLD = 0.75
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
_WORD = "[a-z0-9]+"
_BLANK = "\n([^a-z0-9\n]*\n)+"
HEADER, FILE = -1, -2


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def weights(templates: dict[str, list[str]]) -> tuple[dict[str, float], dict[tuple[str, int], dict[str, float]], float]:
    """Inverse document frequencies, each template's unit vector, and the weight of an unknown word."""
    texts = {(name, i): Counter(_words(t)) for name, some in templates.items() for i, t in enumerate(some)}
    n, found = len(texts), Counter(w for t in texts.values() for w in t)
    idf = {w: math.log((1 + n) / (1 + df)) + 1 for w, df in found.items()}
    vectors = {}
    for key, counts in texts.items():
        v = {w: (1 + math.log(c)) * idf[w] for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[key] = {w: x / norm for w, x in v.items()}
    return idf, vectors, math.log(1 + n) + 1


def decisive(vector: dict[str, float], threshold: float, several: bool) -> tuple[list[str], int]:
    """Words of a template and a number of them without which a unit has a cosine below threshold, as the norm of the template's other
    words, with the heaviest of those that the unit may still have, is too small. Of a short template few words, one of which must be
    there; with ``several`` all but the common ones, as many of which as possible must."""
    most = threshold**2 - 1e-5  # scores are rounded to 6 digits
    some: list[str] = []
    rest = 1.0
    for word in sorted(vector, key=lambda w: (w in COMMON or w.isdigit(), -vector[w], w)):
        if rest < most and not (several and word not in COMMON):
            break
        rest -= vector[word] ** 2
        some.append(word)
    need = 1
    heavy = sorted((vector[w] ** 2 for w in some), reverse=True)
    while need < len(some) and rest + sum(heavy[:need]) < most:
        need += 1
    return some, need


def _any(words: set[str]) -> str:
    """Any of the words, by first letters."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(h + "(?:" + "|".join(t) + ")" for h, t in heads.items()) + ")"


_START, _END = "(?<![a-z0-9])", "(?![a-z0-9])"


def could_match(low, vectors: dict, threshold: float):
    """Whether a text in lower case, or a unit of it, could reach the threshold with any template."""
    one, short, many, need = set(), set(), set(), None
    for v in vectors.values():
        words, least = decisive(v, threshold, len(v) >= LONG)
        if len(v) < LONG:
            one.update(words)
            short.update(v)
        else:
            many.update(words)
            need = least if need is None else min(need, least)
    ok = F.lit(False)
    if one:  # a match has another word of the template besides
        pair = lambda a, b: F.rlike(low, F.lit(f"(?s){_START}({_any(a)}){_END}.*?{_START}(?!\\1{_END}){_any(b)}{_END}"))
        ok = F.rlike(low, F.lit(f"{_START}{_any(one)}{_END}")) & (pair(one, short) | pair(short, one))
    return ok | (F.regexp_count(low, F.lit(f"{_START}{_any(many)}{_END}")) >= need) if many else ok


def text_units(text, named):
    """Array of (unit, value): lines with words from 0, the header as HEADER, the text of a licence file as FILE."""
    low = F.lower(text)
    some = lambda x: x.rlike("[a-z0-9]")
    lines = F.transform(F.filter(F.split(low, "\n"), some), lambda x, i: F.struct(i.cast("int").alias("unit"), x.alias("value")))
    header = F.get(F.filter(F.split(low, _BLANK), some), F.lit(0))
    more = F.array(
        F.when(F.trim(header).contains("\n"), F.struct(F.lit(HEADER).alias("unit"), header.alias("value"))),
        F.when(named, F.struct(F.lit(FILE).alias("unit"), low.alias("value"))),
    )
    return F.concat(lines, F.array_compact(more))


def scan_units(texts: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, named, unit, license and score of every unit that matches a template, of distinct (key, named) with a text."""
    spark: SparkSession = texts.sparkSession
    idf, vectors, unknown = weights(templates)
    table = spark.createDataFrame([(n, i, w, x) for (n, i), v in vectors.items() for w, x in v.items()], "license string, template int, word string, weight double")
    known = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    rows = texts.select("key", "named", F.explode(F.filter(text_units(F.col("text"), F.col("named")), lambda s: could_match(s["value"], vectors, threshold))).alias("s"))
    words = rows.select("key", "named", "s.unit", F.explode(F.regexp_extract_all("s.value", F.lit(f"({_WORD})"), F.lit(1))).alias("word"))
    unit = ["key", "named", "unit"]
    counts = materialize(words.groupBy(*unit, "word").count(), "license_words")
    x = (1 + F.log(F.col("count").cast("double"))) * F.coalesce("idf", F.lit(unknown))
    valued = counts.join(F.broadcast(known), "word", "left").withColumn("x", x)
    norms = valued.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = valued.join(F.broadcast(table), "word").groupBy(*unit, "license", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.count("*").alias("n")).where("n > 1")
    out = dots.join(norms, unit).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    return out.groupBy(*unit, "license").agg(F.max("score").alias("score"))


def ancestors(path):
    """All directories above a path, from the root '' down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i - 1), "/"))


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """row, path, own_license, score, license, and from: 'file', a directory, or null, of files of row, path and text."""
    name, key = F.element_at(F.split("path", "/"), -1), F.md5("text").alias("key")
    named = F.coalesce(name.rlike(FILE_NAMES), F.lit(False)).alias("named")
    texts = files.where(could_match(F.lower("text"), weights(templates)[1], threshold)).select(key, named, "text").groupBy("key", "named").agg(F.any_value("text").alias("text"))
    hits = scan_units(texts, templates, threshold)
    best = hits.groupBy("key", "named").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("top"), F.min("unit").alias("first"))
    best = best.select("key", "named", F.col("top.license").alias("own_license"), (-F.col("top.minus")).alias("score"), "first")
    found = files.select("row", "path", key, named).join(best, ["key", "named"], "left")
    found = materialize(found.select("row", "path", "named", "own_license", "score", "first"), "licenses")
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    licensed = found.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("named") | (F.col("first") <= 0)))
    licensed = licensed.groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "own_license")).alias("top")).select("dir", F.col("top.own_license").alias("inherited"))
    # one row a directory that needs a licence, not one a file
    needy = found.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select(directory.alias("own")).distinct()
    above = needy.select("own", F.explode(ancestors(F.concat("own", F.lit("/")))).alias("dir")).join(licensed, "dir")
    nearest = above.groupBy("own").agg(F.max_by(F.struct("dir", "inherited"), F.length("dir")).alias("n")).select("own", F.col("n.dir").alias("dir"), F.col("n.inherited").alias("inherited"))
    out = found.withColumn("own", F.when(F.col("own_license").isNull(), directory)).join(nearest, "own", "left")
    source = F.when(F.col("own_license").isNotNull(), "file").otherwise(F.col("dir"))
    return out.select("row", "path", "own_license", "score", F.coalesce("own_license", "inherited").alias("license"), source.alias("from"))


def document_path():
    """Documents as files: every hundredth is a licence file of its source's directory, every tenth lies in that of its language."""
    doc, top = F.col("doc_id").cast("string"), F.coalesce("source", F.lit("none"))
    lang = F.coalesce("lang", F.lit("none"))
    deep = F.concat_ws("/", top, lang, F.floor(F.col("doc_id") / 100).cast("string"), doc)
    named = F.concat(top, F.lit("/LICENSE-"), doc)
    return F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("doc_id") % 100 == 0, named).when(F.col("doc_id") % 10 == 0, F.concat_ws("/", top, lang, doc)).otherwise(deep)


def op6_license(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.col("doc_id").alias("row"), document_path().alias("path"), "text")
    return scan(files).withColumnRenamed("row", "doc_id").withColumnRenamed("from", "found_in")


def oracle() -> str:
    idf, vectors, unknown = weights(TEMPLATES)
    known = ", ".join(f"('{w}', {x!r}e0)" for w, x in sorted(idf.items()))
    table = ", ".join(f"('{n}', {i}, '{w}', {x!r}e0)" for (n, i), v in vectors.items() for w, x in v.items())
    return f"""
WITH idf(word, idf) AS (VALUES {known}), template(license, template, word, weight) AS (VALUES {table}),
files AS (SELECT row_number() OVER () AS row, doc_id, lower(text) AS low, CASE WHEN doc_id IS NULL THEN NULL
    WHEN doc_id % 100 = 0 THEN coalesce(source, 'none') || '/LICENSE-' || doc_id
    WHEN doc_id % 10 = 0 THEN coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id
    ELSE coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || (doc_id // 100) || '/' || doc_id END AS path FROM documents),
named AS (SELECT *, coalesce(regexp_matches(split_part(path, '/', -1), '{FILE_NAMES}'), false) AS named FROM files),
split AS (SELECT row, list_filter(string_split(low, chr(10)), lambda x: regexp_matches(x, '[a-z0-9]')) AS l,
  list_filter(string_split_regex(low, '\n([^a-z0-9\n]*\n)+'), lambda x: regexp_matches(x, '[a-z0-9]'))[1] AS header FROM files WHERE low IS NOT NULL),
units AS (SELECT row, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS unit FROM split
  UNION ALL SELECT row, header, {HEADER} FROM split WHERE contains(trim(header), chr(10)) UNION ALL SELECT row, low, {FILE} FROM named WHERE named AND low IS NOT NULL),
counts AS (SELECT row, unit, word, count(*) AS c FROM (SELECT row, unit, unnest(regexp_extract_all(value, '{_WORD}')) AS word FROM units) GROUP BY ALL),
valued AS (SELECT row, unit, counts.word, (1 + ln(c)) * coalesce(idf, {unknown!r}e0) AS x FROM counts LEFT JOIN idf USING (word)),
norms AS (SELECT row, unit, sqrt(sum(x * x)) AS norm FROM valued GROUP BY ALL),
hits AS (SELECT row, unit, license, round(sum(x * weight) / any_value(norm), 6) AS score
  FROM valued JOIN template USING (word) JOIN norms USING (row, unit) GROUP BY row, unit, license, template HAVING count(*) > 1 AND round(sum(x * weight) / any_value(norm), 6) >= {THRESHOLD}),
ranked AS (SELECT row, license, score, min(unit) OVER (PARTITION BY row) AS first, row_number() OVER (PARTITION BY row ORDER BY score DESC, license) AS r FROM hits),
found AS (SELECT f.row, f.doc_id, f.path, f.named, regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS dir, r.license AS own_license, r.score, r.first FROM named f LEFT JOIN ranked r ON f.row = r.row AND r.r = 1),
licensed AS (SELECT dir, own_license AS inherited FROM (SELECT dir, own_license, row_number() OVER (PARTITION BY dir ORDER BY score DESC, own_license) AS r FROM found
  WHERE own_license IS NOT NULL AND path IS NOT NULL AND (named OR first <= 0)) WHERE r = 1),
nearest AS (SELECT f.row, l.dir AS at, l.inherited, row_number() OVER (PARTITION BY f.row ORDER BY length(l.dir) DESC) AS r
  FROM found f JOIN licensed l ON f.own_license IS NULL AND starts_with(f.dir || '/', l.dir || '/'))
SELECT f.doc_id, f.path, f.own_license, f.score, coalesce(f.own_license, n.inherited) AS license,
  CASE WHEN f.own_license IS NOT NULL THEN 'file' ELSE n.at END AS found_in
FROM found f LEFT JOIN nearest n ON f.row = n.row AND n.r = 1
"""


ORACLE = oracle()
