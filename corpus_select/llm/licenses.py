"""Licence scans by canonical digest, with DataFrame functions alone.

Texts are brought to a canonical form: lower case, copyright lines out, every run
of other signs than letters and digits one blank, equivalent spellings one
spelling. Known licences go through the same expressions. A digest of the form
is then hash-joined with the known digests, for each entire text and for each of
its lines (notices stand on lines of their own).

Spelling changes keep the number of words, so only units with as many words as
some known licence are digested; that is exact, not a sample.

Defined results: null text is empty; empty texts and lines match nothing; rows
with the same id (null ids are one) are one document; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts_of

# Spellings that licence matching treats as one (word for word).
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "licencee": "licensee", "licencor": "licensor", "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "cancelled": "canceled",
    "centre": "center", "customisation": "customization", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "merchantibility": "merchantability", "modelled": "modeled", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "recognise": "recognize", "redistributable": "redistributable", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "owner": "holder",
    "owners": "holders", "http": "https", "noncommercially": "noncommercial",
}
_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
             "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
             "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{0}.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution.\n{0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND "
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# Texts of public licences, without titles and copyright lines; see TITLES and ENTIRE for the rest.
LICENSE_TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software.\n" + _WARRANTY),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
                                 "prior written permission.\n")),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission "
             "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The "
             "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
             "documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This "
             "notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n"
                   "http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("all-rights-reserved", "All rights reserved."),
]
# Usual titles of the short licences; "All rights reserved." may stand on a line of its own below them.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "License", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "License", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "0BSD", "License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "2-Clause BSD License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License",
                     "BSD License", "The BSD License", "License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "3-Clause BSD License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
                     "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License", "License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "License", "zlib"],
}
# Entire texts in license_texts/, as their publishers give them with title and appendix.
ENTIRE = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
# Names that notices use; the notices themselves follow from the templates.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "BSD License"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0 1.0", "CC0"],
} | {f"{short}-{v}.0": [f"GNU {name}, version {v}", f"GNU {name} v{v}", f"{short} v{v}", f"{short}-{v}.0"]
     for short, name, versions in (("GPL", "General Public License", (2, 3)), ("LGPL", "Lesser General Public License", (3,)), ("AGPL", "Affero General Public License", (3,))) for v in versions
} | {f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k} {v}", f"CC-{k}-{v}"] for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")}
TEMPLATES = ["{0}", "Licensed under {0}", "Licensed under the {0}", "Released under {0}", "Released under the {0}", "Distributed under the {0}", "Available under the {0}",
             "This work is licensed under {0}", "This work is licensed under the {0}", "This software is licensed under the {0}", "SPDX-License-Identifier: {0}"]

# One pattern for both SQL dialects: a line that starts as a copyright line.
COPYRIGHT = r"^[ \t*#/;-]*(copyright|©|\(c\)|all contents copyright)"
OTHER = r"[^\p{L}\p{N}]+"


def entire_texts() -> list[tuple[str, str]]:
    """(licence, text) of the short licences with each title, reservation line and mark of list items, and of the long ones."""
    bodies = dict(LICENSE_TEXTS)
    short = []
    for lic, titles in TITLES.items():
        for body in {bodies[lic]: None, re.sub(r"\n\d\. ", "\n* ", bodies[lic]): None}:
            short += [(lic, "".join(f"{x}\n" for x in (title, reserved) if x) + body) for title in ["", *titles] for reserved in ("", "All rights reserved.")]
    return short + [(lic, pkgutil.get_data(__package__, f"license_texts/{lic}.txt").decode()) for lic in ENTIRE]


def notices() -> list[tuple[str, str]]:
    """(licence, text) of the known texts, of entire texts with their titles and of every template with every name."""
    return LICENSE_TEXTS + entire_texts() + [(lic, t.format(n)) for lic, names in NAMES.items() for n in names for t in TEMPLATES]


def known_table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(license, text) as a literal table."""
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in rows])).alias("k")).select("k.*")


def plain_lines(text: Column) -> Column:
    """The text's lines in lower case with single blanks between words; copyright and wordless lines are ''."""
    return F.transform(F.split(F.lower(text), "\n"),
                       lambda x: F.when(x.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(F.regexp_replace(x, OTHER, " "))))


def joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def spelled(plain: Column) -> Column:
    """One spelling for each equivalent one; every blank is doubled meanwhile, so that neighbours do not share one."""
    out = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        if a != b:
            out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return out


def words_in(plain: Column) -> Column:
    return F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license, words): the smallest licence name where texts coincide."""
    plain = known.select("license", joined(plain_lines(F.col("text"))).alias("plain")).where("plain <> ''")
    return plain.groupBy(F.sha2(spelled(F.col("plain")), 256).alias("digest")).agg(F.min("license").alias("license"), F.max(words_in(F.col("plain"))).alias("words"))


def scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_license (of an entire text, or null), line_licenses (names found on lines, sorted, joined by commas), n_license_lines."""
    digests = known_digests(known if known is not None else known_table(df.sparkSession, notices()))
    counts = [r["words"] for r in digests.select("words").distinct().collect()]  # of the licence list
    docs = texts_of(df, id_col, text_col).select("doc_id", plain_lines(F.col("text")).alias("lines"))
    whole = F.struct(F.lit(True).alias("whole"), joined(F.col("lines")).alias("plain"))
    lines = F.transform(F.col("lines"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("plain")))
    possible = F.filter(F.concat(F.array(whole), lines), lambda u: (u["plain"] != "") & words_in(u["plain"]).isin(counts))
    units = docs.select("doc_id", F.explode_outer(possible).alias("u")).select("doc_id", "u.whole", F.sha2(spelled(F.col("u.plain")), 256).alias("digest"))
    found = units.join(digests.select("digest", "license"), "digest", "left")
    on_line = F.when(~F.col("whole"), F.col("license"))
    return found.groupBy("doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(on_line)), ",").alias("line_licenses"),
        F.count(on_line).alias("n_license_lines"))


def scan_sql() -> str:
    """DuckDB's form of ``scan`` over documents and the built-in licences."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in notices())

    def spell(e: str) -> str:
        out = f"(' ' || replace({e}, ' ', '  ') || ' ')"
        for a, b in SPELLINGS.items():
            if a != b:
                out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"sha256({out})"

    def plain(e: str) -> str:
        return f"list_transform(string_split(lower({e}), chr(10)), lambda x: CASE WHEN regexp_matches(x, {quoted(COPYRIGHT)}) THEN '' ELSE trim(regexp_replace(x, {quoted(OTHER)}, ' ', 'g')) END)"
    return f"""
WITH known_text(license, text) AS (VALUES {values}),
known AS (SELECT {spell("plain")} AS digest, min(license) AS license FROM
  (SELECT license, array_to_string(list_filter({plain("text")}, lambda x: x <> ''), ' ') AS plain FROM known_text) WHERE plain <> '' GROUP BY 1),
lines AS (SELECT doc_id, {plain("coalesce(text, '')")} AS lines FROM documents),
units AS (SELECT doc_id, true AS whole, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS plain FROM lines
  UNION ALL SELECT doc_id, false, unnest(lines) FROM lines),
found AS (SELECT doc_id, whole, license FROM units LEFT JOIN known ON plain <> '' AND {spell("plain")} = digest)
SELECT doc_id, max(CASE WHEN whole THEN license END) AS text_license,
  coalesce(string_agg(DISTINCT CASE WHEN NOT whole THEN license END, ',' ORDER BY CASE WHEN NOT whole THEN license END), '') AS line_licenses,
  count(CASE WHEN NOT whole THEN license END) AS n_license_lines
FROM found GROUP BY doc_id"""
