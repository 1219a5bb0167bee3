"""Licence scans by canonical digest: whole texts are normalised, digested and hash-joined.

A text unit is a whole document (``line`` 0) or one of its lines (from 1). Units are
lower-cased, statements of a copyright and numbers of list items are taken out, everything
but letters and digits becomes one blank, and equivalent spellings become one. A line that
goes on from its statement with a known text keeps that text; a line that begins with
"copyright notice", "copyright holders" or the like is prose and stays. The SHA-256 of what
is left is looked up among the digests of known licences, with and without their titles, a
table that does not grow with the data and is broadcast. Everything is DataFrame functions.
A digest under two licences is the one of the least identifier.

Null and empty texts, and units without a letter or digit, match nothing. Rows that repeat
an id each report their own matches. A document with a null id reports its matches under
that id. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.rows import document_rows

# --------------------------------------------------------- fixed values: what is looked up
#: Licence identifier and the names it goes by.
NAMES = {
    "MIT": ("MIT License", "MIT", "The MIT License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
}
#: Notices that grant a licence by its name.
NOTICES = (
    "{name}", "Released under {name}", "Released under the {name}", "Licensed under {name}",
    "Licensed under the {name}", "This work is licensed under {name}", "This work is licensed under the {name}",
    "Distributed under the {name}", "SPDX-License-Identifier: {name}", "License: {name}",
)
#: Whole licence texts that are short enough to be stated here.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE. For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
}
#: Title lines that stand above a whole text.
TITLES = ("{name}", "The {name}", "{name} ({id})", "The {name} ({id})")
#: Words by which a known text is found after a statement on its line.
OPENING_WORDS = 4
#: How a lower-cased line that states a copyright begins, and how one does that only says the word.
STATEMENT = r"^\s*(?:copyright\b|©|\(c\)|all rights reserved\W*$)"
PROSE = r"^\s*copyright(?:\s+(?:notices?|holders?|owners?|laws?|licen[cs]es?|interests?|statements?|protections?|and|or)\b|\s*[,.;]|$)"
#: The number of a list item.
ITEM = r"(^|\s)\(?[1-9][.)]\s"
#: Lower-cased spellings that mean the same, as a pattern and what it becomes.
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bper cent\b", "percent"),
    (r"\bv (\d)", "version $1"),
    (r"\bv(\d)", "version $1"),
    (r"\bhttps\b", "http"),
)


def _openings() -> str:
    """A pattern of the first words of every whole text and what follows them."""
    words = (re.findall(r"[^\W_]+", text.lower())[:OPENING_WORDS] for text in TEXTS.values())
    return r"\b(?:" + "|".join(sorted({" ".join(first) for first in words})) + r")\b.*$"


def canonical(line: Column) -> Column:
    """One line in canonical form; lines become one text again with a blank between them."""
    told = F.trim(F.lower(line))
    words = F.regexp_replace(told, ITEM, "$1")
    words = F.trim(F.regexp_replace(words, r"[^\p{L}\p{N}]+", " "))
    for pattern, spelling in SPELLINGS:
        words = F.regexp_replace(words, pattern, spelling)
    stated = told.rlike(STATEMENT) & ~told.rlike(PROSE)
    return F.when(stated, F.regexp_extract(words, _openings(), 0)).otherwise(words)


def _units(rows: DataFrame) -> DataFrame:
    """``doc_id, line, digest`` of every unit that has a letter or digit."""
    lines = F.transform(F.split("text", "\r?\n|\r"), canonical)
    kept = rows.select("doc_id", lines.alias("lines"))
    whole = F.array_join(F.filter("lines", lambda line: line != ""), " ")
    units = kept.select("doc_id", F.posexplode(F.concat(F.array(whole), "lines")).alias("line", "unit"))
    digest = F.sha2(F.col("unit").cast("binary"), 256)
    return units.filter("unit <> ''").select("doc_id", F.col("line").cast("bigint").alias("line"), digest.alias("digest"))


def known_texts() -> list[tuple[str, str]]:
    """Identifier and text of every known licence and notice."""
    notices = [(i, notice.format(name=name)) for i, names in NAMES.items() for name in names for notice in NOTICES]
    titled = [
        (i, title.format(name=name, id=i) + "\n" + text)
        for i, text in TEXTS.items()
        for name in NAMES[i]
        for title in TITLES
    ]
    return notices + titled + list(TEXTS.items())


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``digest, licence_id`` of known texts, one row a digest (the least identifier)."""
    rows = spark.createDataFrame(texts, "licence_id string, text string")
    lines = F.transform(F.split("text", "\r?\n|\r"), canonical)
    whole = F.array_join(F.filter(lines, lambda line: line != ""), " ")
    digest = F.sha2(whole.cast("binary"), 256).alias("digest")
    return rows.groupBy(digest).agg(F.min("licence_id").alias("licence_id"))


def scan_licences(
    docs: DataFrame, texts: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, line, licence_id, digest`` of every unit that is a known licence or notice."""
    known = known_digests(docs.sparkSession, known_texts() if texts is None else texts)
    units = _units(document_rows(docs, id_col, text_col))
    return units.join(F.broadcast(known), "digest").select("doc_id", "line", "licence_id", "digest")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(line: str) -> str:
    """The same rules in RE2: a statement is told by what may follow the word, in one test for each."""
    told = f"trim(lower({line}))"
    words = rf"regexp_replace({told}, '(^|\s)[(]?[1-9][.)]\s', '\1', 'g')"
    words = rf"trim(regexp_replace({words}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for pattern, spelling in SPELLINGS:
        words = f"regexp_replace({words}, {_sql_text(pattern)}, {_sql_text(spelling.replace('$', chr(92)))}, 'g')"
    prose = r"^\s*copyright(\s+(notice|holder|owner|law|licen[cs]e|interest|statement|protection)s?\b|\s+(and|or)\b|\s*[,.;]|$)"
    stated = rf"""((regexp_matches({told}, '^\s*([(]c[)]|©)') OR regexp_full_match({told}, '\s*all rights reserved\W*')
        OR regexp_matches({told}, '^\s*copyright\b')) AND NOT regexp_matches({told}, '{prose}'))"""
    return f"CASE WHEN {stated} THEN regexp_extract({words}, {_sql_text(_openings())}, 0) ELSE {words} END"


def oracle() -> str:
    """The scan of ``documents`` in DuckDB SQL."""
    values = ",\n".join(f"({_sql_text(i)}, {_sql_text(text)})" for i, text in known_texts())
    lines = rf"list_transform(regexp_split_to_array(text, '\r?\n|\r'), lambda line: {_sql_canonical('line')})"
    whole = "array_to_string(list_filter(lines, lambda line: line <> ''), ' ')"
    return f"""
WITH known AS (
    SELECT sha256({whole}) AS digest, min(licence_id) AS licence_id
    FROM (SELECT licence_id, {lines} AS lines FROM (VALUES {values}) AS told(licence_id, text)) GROUP BY 1
), split AS (
    SELECT doc_id, {lines} AS lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), units AS (
    SELECT doc_id, 0 AS line, {whole} AS unit FROM split
    UNION ALL
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS unit FROM split
)
SELECT doc_id, CAST(line AS BIGINT) AS line, licence_id, digest
FROM (SELECT doc_id, line, sha256(unit) AS digest FROM units WHERE unit <> '') JOIN known USING (digest)
"""
