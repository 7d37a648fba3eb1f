"""Licence texts and notices, found by the digest of their canonical form.

A text's canonical form has no copyright lines, no case, no punctuation and one spelling of words that licences spell
differently. Entire texts are compared: a whole document, each of its blocks of lines, each line, and each run of
neighbouring blocks that begins like a known text, so that a licence in its usual paragraphs is found within a larger
document however its paragraphs are divided. Their digests are joined with the digests of known texts, a table of fixed size
that Spark broadcasts; only rows that are found are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.common import UPPER

# Spellings that count as one (words without punctuation, in this order).
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("sub licensable", "sublicensable"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("no derivatives", "noderivatives"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("copyright holders", "copyright holder"),
    ("per cent", "percent"),
    ("https", "http"),
    ("v 2", "version 2"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("ver 2", "version 2"),
    ("ver 3", "version 3"),
]
COPYRIGHT = (
    r"\n[ \t/*#;!<>-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<year>|\[year\]|by )|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
)
NOT_WORD = r"[^\p{L}\p{N}]+"
BLOCK_END = r"\n[ \t\r\n]*\n"
# Wordings of a notice that count as one, applied in this order to the words of a text.
WORDINGS = [
    (r"^ *this (?:work|file|software|project|program|document|content|page|article|text|code|package) is ", " "),
    (r" (?:released|distributed|available|published|provided|made available|offered) under ", " licensed under "),
    (r" under (?:the terms of )?(?:the|an?) ", " under "),
]
# Every known text has one of these words; a test holds it to that. Units without them are not looked at further.
HINT = r"(?i)licen[cs]|permission|redistribut|public domain|warrant"

# Identifiers and names of licences.
NAMES = {
    "MIT": ["MIT License", "MIT/X11 License", "Expat License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "Zlib"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0-1.0"],
} | {
    # Creative Commons names follow one rule.
    f"CC-{kind}-{version}": [
        f"CC {kind} {version}",
        f"CC-{kind}-{version}",
        f"Creative Commons {words} {version} International License",
        f"Creative Commons {words} {version} License",
    ]
    for version in ("3.0", "4.0")
    for kind, words in {
        "BY": "Attribution",
        "BY-SA": "Attribution-ShareAlike",
        "BY-ND": "Attribution-NoDerivatives",
        "BY-NC": "Attribution-NonCommercial",
        "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
        "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    }.items()
}
# Short licences in full, without copyright lines.
FULL_TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}


# The licence of three clauses is that of two with one more.
FULL_TEXTS["BSD-3-Clause"] = FULL_TEXTS["BSD-2-Clause"].replace(
    "\n\nTHIS SOFTWARE IS",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS",
)
FULL_TEXTS["BSL-1.0"] = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
# Standard notices of licences that are too long to be quoted in full.
NOTICES = {
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at https://mozilla.org/MPL/2.0/.\n\nThis Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.\n\nYou should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <https://creativecommons.org/publicdomain/zero/1.0/>.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
}
GNU = {
    "GPL-2.0": ("General", "2"),
    "GPL-3.0": ("General", "3"),
    "LGPL-2.1": ("Lesser General", "2.1"),
    "LGPL-3.0": ("Lesser General", "3"),
    "AGPL-3.0": ("Affero General", "3"),
}
GNU_ENDS = (
    "If not, see <https://www.gnu.org/licenses/>.",
    "If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "If not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
)
CC_ENDS = (
    "",
    " or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    " or send a letter to Creative Commons, 444 Castro Street, Suite 900, Mountain View, California, 94041, USA.",
)


def gnu_notices(kind: str, version: str) -> list[str]:
    """The notice as the licence gives it: its first paragraph, its first two, or all three, for a program or a library."""
    notices = []
    for noun in ("program", "library", "software"):
        for choice in (f"either version {version} of the License, or (at your option) any later version", f"version {version} of the License"):
            first = (
                f"This {noun} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public"
                f" License as published by the Free Software Foundation, {choice}."
            )
            second = (
                f"This {noun} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
                f" warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
            )
            third = f"You should have received a copy of the GNU {kind} Public License along with this {noun}. "
            notices += [first, f"{first}\n\n{second}", *[f"{first}\n\n{second}\n\n{third}{end}" for end in GNU_ENDS]]
    return notices


def known_texts() -> list[tuple[str, str]]:
    """Identifier and text: full texts, also without their title; SPDX lines; standard notices; and notices by rule."""
    rows = list(FULL_TEXTS.items())
    rows += [(name, text.split("\n\n", 1)[1]) for name, text in FULL_TEXTS.items() if name in ("MIT", "ISC", "BSL-1.0")]
    rows.append(("Unlicense", FULL_TEXTS["Unlicense"] + "\n\nFor more information, please refer to <https://unlicense.org/>"))
    rows += [(name, notice) for name, notices in NOTICES.items() for notice in notices]
    rows += [(name, notice) for name, of in GNU.items() for notice in gnu_notices(*of)]
    for identifier, names in NAMES.items():
        rows.append((identifier, f"SPDX-License-Identifier: {identifier}"))
        titles = names + [f"{name} license" for name in names if not name.endswith("License")]
        rows += [(identifier, f"{intro} {title}") for title in titles for intro in ("License:", "Licensed under")]
        if identifier.startswith("CC-"):
            kind, version = identifier.removeprefix("CC-").lower().rsplit("-", 1)
            address = f"To view a copy of this license, visit https://creativecommons.org/licenses/{kind}/{version}/"
            rows += [(identifier, f"Licensed under {title}. {address}{end}") for title in names[2:] for end in CC_ENDS]
    return rows


# A run of blocks has at most as many as the longest known text, and some that its paragraphs may be divided into.
RUN = 3 + max(text.count("\n\n") + 1 for _, text in known_texts())
OPENING = r"^\S+(?: \S+){0,3}"


def canonical(text: Column) -> Column:
    """The canonical form; empty if nothing is left."""
    lowered = F.translate(text, UPPER, UPPER.lower())
    unsigned = F.regexp_replace(F.concat(F.lit("\n"), lowered), F.lit(COPYRIGHT), F.lit(""))
    spaced = F.replace(unsigned, F.lit("&"), F.lit(" and "))
    words = F.concat(F.lit(" "), F.regexp_replace(spaced, F.lit(NOT_WORD), F.lit(" ")), F.lit(" "))
    spelt = reduce(lambda one, pair: F.replace(one, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, words)
    return F.btrim(reduce(lambda one, pair: F.regexp_replace(one, F.lit(pair[0]), F.lit(pair[1])), WORDINGS, spelt))


def block_forms(text: Column) -> Column:
    """Number and canonical form of each block that has one."""
    blocks = F.split(text, BLOCK_END, -1)
    forms = F.transform(blocks, lambda part, at: F.struct(at.alias("place"), canonical(part).alias("form")))
    return F.filter(forms, lambda one: one["form"] != "")


def by_blocks(text: Column) -> Column:
    """The canonical forms of a text's blocks."""
    return F.transform(block_forms(text), lambda one: one["form"])


def values(spark: SparkSession, rows: list[tuple[str, str]], first: str, second: str) -> DataFrame:
    """Pairs of texts as rows of the plan, of a size that Spark knows, in one statement."""
    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    listed = ", ".join(f"({quoted(one)}, {quoted(two)})" for one, two in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS known({first}, {second})")


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """`digest`, `license`: one row per canonical form of a text, or of its blocks one after the other; of two names for one
    form the first in order counts."""
    rows = values(spark, texts, "license", "text")
    both = F.array(canonical(F.col("text")), F.array_join(by_blocks(F.col("text")), " "))
    forms = rows.select(F.explode(both).alias("form"), "license").filter("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def openings(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """`words`: the first words of the texts of several blocks, and of their first blocks, which may be titles."""
    rows = values(spark, [one for one in texts if "\n\n" in one[1]], "license", "text")
    forms = rows.select(by_blocks(F.col("text")).alias("_forms"))
    starts = F.array(F.array_join("_forms", " "), F.get("_forms", F.lit(0)))
    words = forms.select(F.explode(starts).alias("form")).select(F.regexp_extract("form", OPENING, 0).alias("words"))
    return words.distinct()


# Digests and first words of the built-in texts, some hundred short rows, once they have been computed.
BUILT_IN: list[tuple[list[tuple[str, str]], list[str]]] = []


def built_in(spark: SparkSession) -> tuple[list[tuple[str, str]], list[str]]:
    if not BUILT_IN:
        digests = [tuple(row) for row in known_digests(spark, known_texts()).collect()]
        words = [row["words"] for row in openings(spark, known_texts()).collect()]
        BUILT_IN.append((sorted(digests), sorted(words)))
    return BUILT_IN[0]


def units(text: Column) -> Column:
    """The text's scopes: itself; its blocks of several lines, if it has several blocks; its lines, if it has several."""
    blocks, lines = F.split(text, BLOCK_END, -1), F.split(text, "\n", -1)

    def made(scope: str, parts: Column, wanted) -> Column:
        numbered = F.transform(parts, lambda part, at: F.struct(F.lit(scope).alias("scope"), at.alias("place"), part.alias("part")))
        return F.filter(numbered, wanted)

    def hinted(one: Column) -> Column:
        return F.regexp_like(one["part"], F.lit(HINT))

    return F.concat(
        made("document", F.array(text), hinted),
        F.when(F.size(blocks) > 1, made("block", blocks, lambda one: one["part"].contains("\n") & hinted(one))).otherwise(F.array()),
        F.when(F.size(lines) > 1, made("line", lines, hinted)).otherwise(F.array()),
    )


def runs(forms: Column, first_words: list[str]) -> Column:
    """The runs of several blocks that begin like a known text: numbers of the first and last block, and the form."""
    n = F.size(forms)
    # One constant, which Spark folds, rather than hundreds.
    known_words = F.split(F.lit("\n".join(first_words)), "\n")
    begins = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda p: (p < n - 1) & F.array_contains(known_words, F.regexp_extract(F.get(forms, p)["form"], OPENING, 0)),
    )

    def run(p: Column, k: Column) -> Column:
        some = F.slice(forms, p + 1, k)
        return F.struct(
            F.lit("blocks").alias("scope"),
            F.get(forms, p)["place"].alias("place"),
            F.lit(None).cast("string").alias("part"),
            F.get(forms, p + k - 1)["place"].alias("last"),
            F.array_join(F.transform(some, lambda one: one["form"]), " ").alias("form"),
        )

    made = F.transform(begins, lambda p: F.transform(F.sequence(F.lit(2), F.least(F.lit(RUN), n - p)), lambda k: run(p, k)))
    return F.when(n > 1, F.flatten(made)).otherwise(F.array())


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """A row per licence text found: `doc_id`, `scope`, `place` (number of the block or line from 0), `license`, `digest`.

    A whole text, block, line or run of blocks (`blocks`, by its first) is found if its canonical form is that of a known
    text. Of runs that begin or end with the same block the longest counts, and none in a document that is a known text as
    a whole. NULL, empty and blank texts hold none. Every row is a document, whatever its id; repeated rows give repeated
    results. An empty table gives no rows; other columns are not read. `known` (`digest`, `license`) replaces the built-in
    table, one row per digest; runs begin like the built-in texts then too.
    """
    spark = df.sparkSession
    rows = df.select(df[doc_id].alias("doc_id"), df[text].cast("string").alias("text"))
    hinted = rows.filter(F.regexp_like("text", F.lit(HINT))).withColumn("_row", F.monotonically_increasing_id())
    formed = hinted.withColumn("_forms", block_forms(F.col("text")))
    none = (F.lit(None).cast("int").alias("last"), F.lit(None).cast("string").alias("form"))
    plain = F.transform(units(F.col("text")), lambda one: F.struct(one["scope"].alias("scope"), one["place"].alias("place"), one["part"].alias("part"), *none))
    built_in_digests, first_words = built_in(spark)
    every = formed.select("doc_id", "_row", F.inline(F.concat(plain, runs(F.col("_forms"), first_words))))
    form = F.coalesce(F.col("form"), canonical(F.col("part")))
    digests = every.select("doc_id", "_row", "scope", "place", "last", F.sha2(form, 256).alias("digest"))
    # The built-in table is some hundred literal rows; one that is given is broadcast only if Spark finds it small.
    table = F.broadcast(values(spark, built_in_digests, "digest", "license")) if known is None else known
    found = digests.join(table, "digest")
    is_run = F.col("scope") == "blocks"
    same_row = Window.partitionBy("_row")
    whole = F.max((F.col("scope") == "document").cast("int")).over(same_row) == 1
    longest = F.max("last").over(Window.partitionBy("_row", "scope", "place"))
    widest = F.min("place").over(Window.partitionBy("_row", "scope", "last"))
    kept = found.withColumn("_whole", whole).filter(~is_run | (~F.col("_whole") & (F.col("last") > F.col("place"))))
    kept = kept.withColumn("_longest", longest).filter(~is_run | (F.col("last") == F.col("_longest")))
    kept = kept.withColumn("_widest", widest).filter(~is_run | (F.col("place") == F.col("_widest")))
    return kept.select("doc_id", "scope", "place", "license", "digest")


def oracle_sql() -> str:
    """The same over `documents`, in another dialect."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(column: str) -> str:
        lowered = f"translate({column}, '{UPPER}', '{UPPER.lower()}')"
        unsigned = f"regexp_replace(chr(10) || {lowered}, {quoted(COPYRIGHT)}, '', 'g')"
        words = f"' ' || regexp_replace(replace({unsigned}, '&', ' and '), {quoted(NOT_WORD)}, ' ', 'g') || ' '"
        spelt = reduce(lambda one, pair: f"replace({one}, ' {pair[0]} ', ' {pair[1]} ')", SPELLINGS, f"({words})")
        worded = reduce(lambda one, pair: f"regexp_replace({one}, {quoted(pair[0])}, '{pair[1]}', 'g')", WORDINGS, spelt)
        return f"trim({worded})"

    values = ",\n".join(f"({quoted(name)}, {quoted(text)})" for name, text in known_texts())
    hint, end, opening = quoted(HINT), quoted(BLOCK_END), quoted(OPENING)
    return f"""
WITH known(license, text) AS (VALUES {values}),
known_blocks AS (SELECT license, text, unnest(range(len(blocks))) AS pos, unnest(blocks) AS part
                 FROM (SELECT license, text, regexp_split_to_array(text, {end}) AS blocks FROM known)),
known_runs AS (SELECT license, text, string_agg(form, ' ' ORDER BY pos) AS form
               FROM (SELECT license, text, pos, {form("part")} AS form FROM known_blocks) WHERE form <> '' GROUP BY license, text),
forms AS (SELECT {form("text")} AS form, license, text FROM known UNION ALL SELECT form, license, text FROM known_runs),
starts AS (SELECT form, text FROM known_runs UNION ALL SELECT {form("part")}, text FROM known_blocks WHERE pos = 0),
openings AS (SELECT DISTINCT regexp_extract(form, {opening}) AS words FROM starts WHERE contains(text, chr(10) || chr(10))),
digests AS (SELECT sha256(form) AS digest, min(license) AS license FROM forms WHERE form <> '' GROUP BY form),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_split_to_array(text, {end}) AS blocks, string_split(text, chr(10)) AS lines
         FROM documents WHERE regexp_matches(text, {hint})),
blocks AS (SELECT r, doc_id, unnest(range(len(blocks))) AS place, unnest(blocks) AS part FROM docs WHERE len(blocks) > 1),
parts AS (
  SELECT r, doc_id, 'document' AS scope, 0 AS place, text AS part FROM docs
  UNION ALL
  SELECT r, doc_id, 'block', place, part FROM blocks
  UNION ALL
  SELECT r, doc_id, 'line', unnest(range(len(lines))), unnest(lines) FROM docs WHERE len(lines) > 1
),
formed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY place) AS p
           FROM (SELECT r, doc_id, place, {form("part")} AS form FROM blocks) WHERE form <> ''),
lists AS (SELECT r, list(form ORDER BY p) AS forms, list(place ORDER BY p) AS places FROM formed GROUP BY r),
runs AS (
  SELECT f.r, doc_id, place, places[p + n - 1] AS last, sha256(array_to_string(forms[p:p + n - 1], ' ')) AS digest
  FROM formed f JOIN lists USING (r), (SELECT unnest(range(2, {RUN + 1})) AS n)
  WHERE p + n - 1 <= len(forms) AND regexp_extract(form, {opening}) IN (SELECT words FROM openings)
),
found AS (
  SELECT r, doc_id, scope, place, license, digest
  FROM (SELECT r, doc_id, scope, place, sha256({form("part")}) AS digest FROM parts
        WHERE (scope <> 'block' OR contains(part, chr(10))) AND regexp_matches(part, {hint})) JOIN digests USING (digest)
),
found_runs AS (
  SELECT r, doc_id, place, last, license, digest FROM runs JOIN digests USING (digest)
  WHERE r NOT IN (SELECT r FROM found WHERE scope = 'document')
  QUALIFY last = max(last) OVER (PARTITION BY r, place)
)
SELECT doc_id, scope, CAST(place AS INTEGER) AS place, license, digest FROM found
UNION ALL
SELECT doc_id, 'blocks', CAST(place AS INTEGER), license, digest FROM
  (SELECT * FROM found_runs QUALIFY place = min(place) OVER (PARTITION BY r, last))
"""
