"""License scans: canonical digests of whole texts and of lines, looked up in a table of known licenses."""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known digests that a join may broadcast, about 100 bytes each.
FEW_KNOWN = 100_000

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)

#: Whole texts in license_texts; the file's name is the identifier. A text also counts without what follows its last clause.
TEXTS = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
_END = "END OF TERMS AND CONDITIONS"

#: Names of licenses in short notices, by SPDX identifier.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("BSD Zero Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal", "CC0-1.0"),
}
for _id, _name, _versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))):
    for _v in _versions:
        _full, _or_later = _v if "." in _v else _v + ".0", f"{_id}-{_v if '.' in _v else _v + '.0'}-or-later"
        NAMES[f"{_id}-{_full}"] = tuple(dict.fromkeys([f"{_name}, version {_v}", f"{_name} version {_full}", f"{_name} v{_full}", f"{_name} v{_v}", f"GNU {_id} v{_v}", f"GNU {_id} version {_v}", f"{_id} v{_v}", f"{_id} version {_v}", f"{_id}v{_v}", f"{_id} {_v}", f"{_id} {_full}", f"{_id}-{_full}-only"]))
        NAMES[_or_later] = tuple(dict.fromkeys([f"{_name}, version {_v} or later", f"{_name}, version {_v} or any later version", f"{_name} v{_full} or later", f"{_name} v{_v} or later", f"{_id} v{_v} or later", f"{_id}v{_v} or later", f"{_id} version {_v} or later", f"{_id}-{_full}-or-later"]))
for _kind, _name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _scope in (("1.0", " Generic"), ("2.0", " Generic"), ("2.5", " Generic"), ("3.0", " Unported"), ("4.0", " International")):
        NAMES[f"CC-{_kind}-{_v}"] = (f"Creative Commons {_name} {_v}", f"Creative Commons {_name} {_v}{_scope}", f"Creative Commons {_name} {_v} License", f"Creative Commons {_name} {_v}{_scope} License", f"CC {_kind} {_v}", f"CC {_kind} {_v}{_scope}")

#: What stands before a name in a short notice.
NOTICES = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This file is licensed under", "This text is licensed under")


def _notices(license: str, names: tuple[str, ...]) -> list[tuple[str, str]]:
    articles = ("", "the ", "a ") if license.startswith("CC-") else ("", "the ")
    said = [f"{notice} {article}{name}." for name in names for notice in NOTICES for article in articles]
    return [(license, x) for x in [*said, f"SPDX-License-Identifier: {license}", *[f"License: {name}" for name in (license, *names)]]]


def _later(license: str, name: str, version: str) -> list[tuple[str, str]]:
    """The notices that the Free Software Foundation proposes, with and without the choice of a later version, as a whole and by sentence."""
    out = []
    for kind, choice in ((license, f"version {version} of the License."), (license + "-or-later", f"either version {version} of the License, or (at your option) any later version.")):
        for what in ("program", "library", "software", "file"):
            for sign in (":", ";"):
                first = f"This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {choice}"
                rest = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
                seen = f"You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
                out += [(kind, first), (kind, f"{first} {rest}"), (kind, f"{first} {rest} {seen}")]
    return out


def _whole_texts() -> list[tuple[str, str]]:
    out = []
    for license in TEXTS:
        body = (pkgutil.get_data(__package__, f"license_texts/{license}") or b"").decode()
        at = body.rfind(_END)
        out += [(license, body)] if at < 0 else [(license, body), (license, body[: at + len(_END)]), (license, body[:at])]
    return out


#: Published license texts and notices, as (SPDX identifier, text).
_PUBLISHED = (
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_2 + _BSD_WARRANTY),
    ("BSD-2-Clause", _BSD_2 + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
_PROPOSED = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"))
KNOWN = (*_PUBLISHED, *_whole_texts(), *[x for row in _PROPOSED for x in _later(*row)], *[x for license, names in NAMES.items() for x in _notices(license, names)])

#: Spellings that count as the same, wherever they stand.
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("noninfringment", "noninfringement"), ("favour", "favor"), ("whilst", "while"))

#: A line that names a copyright holder (by a sign or a year; a wrapped line may begin with the word) or reserves rights.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[^\n]*(\(c\)|©|[0-9]{4})|\(c\)[^\n]*[0-9]{4}|©)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"


def canonical_lines(text: Column) -> Column:
    """The lines of a text that say anything: in lower case, without copyright lines, each run of other characters than letters and digits one space, in one spelling."""
    text = F.lower(F.translate(text, "\r", "\n"))
    text = F.regexp_replace(F.replace(text, F.lit("https://"), F.lit("http://")), COPYRIGHT_LINE, "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for one, other in SPELLINGS:
        text = F.replace(text, F.lit(one), F.lit(other))
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def canonical(lines: Column) -> Column:
    """The whole text of its canonical lines."""
    return F.array_join(lines, " ")


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """digest, license of the known texts; a digest of several licenses keeps the first by name."""
    rows = spark.createDataFrame(list(known), "license string, body string")
    return rows.groupBy(F.sha2(canonical(canonical_lines(F.col("body"))), 256).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, text_license, line_licenses, n_lines of each row of docs.

    The whole text and each of its lines that says anything are normalised and hashed; equality joins with the known digests find
    text_license (null if the whole text is none) and line_licenses (sorted, distinct; empty if none); n_lines counts the lines
    found. A null or empty text has the digest of the empty text and no license. Each row gets a row of its own text, also where a doc_id
    repeats or is null. An empty table gives no rows; other columns are ignored. Columns of known: digest (each once), license. It is
    broadcast after a count, beyond which both sides are shuffled.
    """
    known = known.select(F.col("digest").alias("known_digest"), F.col("license").alias("known_license"))
    known = F.broadcast(known) if known.count() <= FEW_KNOWN else known
    lines = docs.select("doc_id", canonical_lines(F.coalesce(F.col("text"), F.lit(""))).alias("lines"))
    # texts are normalised once; rows are numbered as they are written
    rows = table(lines.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(canonical(F.col("lines")), 256).alias("text_digest"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("digests")), "license-digests")
    whole = rows.join(known, rows["text_digest"] == known["known_digest"], "left").select("doc_id", "row", "text_digest", F.col("known_license").alias("text_license"))
    found = rows.select("row", F.explode("digests").alias("known_digest")).join(known, "known_digest")
    found = found.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_set("known_license")).alias("line_licenses"), F.count(F.lit(1)).alias("n_lines"))
    none = F.array().cast("array<string>")
    return whole.join(found, F.col("row") == F.col("of"), "left").select("doc_id", "text_digest", "text_license", F.coalesce("line_licenses", none).alias("line_licenses"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))


def _sql_lines(text: str) -> str:
    text = f"regexp_replace(replace(lower(replace({text}, chr(13), chr(10))), 'https://', 'http://'), '{COPYRIGHT_LINE}', '', 'g')"
    text = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for one, other in SPELLINGS:
        text = f"replace({text}, '{one}', '{other}')"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
ORACLE = f"""
WITH k AS (SELECT sha256(array_to_string({_sql_lines('body')}, ' ')) AS digest, min(license) AS license FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN)}) v(license, body) GROUP BY 1),
c AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_sql_lines("coalesce(text, '')")} AS lines FROM documents),
w AS (SELECT r, doc_id, sha256(array_to_string(lines, ' ')) AS text_digest FROM c),
l AS (SELECT r, unnest(lines) AS line FROM c),
f AS (SELECT r, list_sort(list(DISTINCT license)) AS line_licenses, count(*) AS n_lines FROM l JOIN k ON sha256(line) = digest GROUP BY r)
SELECT w.doc_id, text_digest, license AS text_license, coalesce(line_licenses, []::VARCHAR[]) AS line_licenses, coalesce(n_lines, 0)::BIGINT AS n_lines
FROM w LEFT JOIN k ON text_digest = digest LEFT JOIN f ON w.r = f.r
"""
