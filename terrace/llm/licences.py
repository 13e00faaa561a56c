"""Licence scans by canonical digests, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices by SPDX identifier. Line ends and letter case don't matter.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY}"""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, f"MIT License\n\n{_MIT}", f"The MIT License (MIT)\n\n{_MIT}", "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "ISC": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}", "SPDX-License-Identifier: ISC"),
    "0BSD": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_TAIL}", "SPDX-License-Identifier: 0BSD"),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL, f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_TAIL}", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}", "SPDX-License-Identifier: BSD-3-Clause"),
    "Apache-2.0": (_APACHE_NOTICE, "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
}
# digest() of long public licence texts by SPDX identifier, whole and, where they have appendices, up to the end of their terms.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("4f8caa9a32c00fbc0b82aa9c4bec85c3", "28ebc01248a8dee857c26cb670d23345"),
    "Artistic-1.0-Perl": ("a8b0fb0c6e43a3b36bdc159e59dbfd1e",),
    "CC0-1.0": ("d2a76f70ce19809695b7fb93c6241c23",),
    "GFDL-1.2-only": ("fc8fd4dca9351a1b1ba045c2a7d3d70f",),
    "GFDL-1.3-only": ("3564867804d3e20f9506651fedbca0e9",),
    "GPL-1.0-only": ("97008616a6c74f408568b284dd04871d", "dbf3c47f5a8f127e58d08cabc1ebb916"),
    "GPL-2.0-only": ("bc956f44d1c84837504c207f245fa68b", "68380dbeadb093b94ecf563db7312db7"),
    "GPL-3.0-only": ("a5c6580b91c7c81bdcc9605523100355", "444f95dc767ede978b60cfb20fbd0bca"),
    "LGPL-2.0-only": ("6885b1a1b528de907e6c89bd80a1ea4f", "c396ba2f94537628797123bc12cd2d6e"),
    "LGPL-2.1-only": ("79aa7998cfa6069eae71d7bea9b32641", "3054b3781b1af43f906dc753acad15ee"),
    "LGPL-3.0-only": ("b31b7335bc37919e8cdd79154e04d88d",),
    "MPL-1.1": ("b7edc06df79bc44a04f12befb8111960",),
    "MPL-2.0": ("0d0c617863ffeb16c5cb1f094c2d68b2",),
}
# Spellings that count as the same, after letter case and punctuation are gone.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("customisation", "customization"),
    ("utilisation", "utilization"),
    ("programme", "program"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("labour", "labor"),
    ("judgement", "judgment"),
    ("fulfilment", "fulfillment"),
    ("per cent", "percent"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
)
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|[<\[{]|yyyy)|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines; letters and digits alone, runs of anything else one space; spellings alike. Null stays null."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), OTHER, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known(spark: SparkSession) -> DataFrame:
    """(digest, license) of TEXTS and DIGESTS: some dozens of rows."""
    rows = spark.createDataFrame([(name, t) for name, texts in TEXTS.items() for t in texts], "license string, text string")
    made = spark.createDataFrame([(d, name) for name, digests in DIGESTS.items() for d in digests], "digest string, license string")
    return rows.select(digest(F.col("text")).alias("digest"), "license").unionByName(made).distinct()


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, notices): the licence that each entire text is, and those that single lines of it are.

    license: the known licence whose digest the whole text's canonical form has, or null. notices: the sorted, distinct licences
    of which an entire line is a known text, joined by commas, or null. digest is null for a null text; an empty text has the empty
    text's digest and no licence. The known texts are a constant of the code, so they are sent to every executor; documents'
    texts are not shuffled, only ids of rows with a notice. Rows that repeat a doc_id each get the notices of all of them. Other columns
    are ignored; an empty table gives an empty result, and very long texts are only slower. `more`: further known texts (license, text), of any number; a digest of several licences gives
    the first by name.
    """
    table, sent = known(docs.sparkSession), F.broadcast
    if more is not None:
        own = more.where("license is not null and text is not null").select(digest(F.col("text")).alias("digest"), "license")
        table, sent = table.unionByName(own).groupBy("digest").agg(F.min("license").alias("license")), lambda x: x
    whole = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(sent(table), "digest", "left")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", digest(F.col("line")).alias("digest"))
    found = lines.join(sent(table), "digest").groupBy("doc_id", "license").agg(F.count("*").alias("n"))
    notices = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return whole.join(notices, "doc_id", "left").select("doc_id", "digest", "license", "notices")


def oracle() -> str:
    """DuckDB SQL of scan() over documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def sql(text: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, ' ', 'g'), {quote(OTHER)}, ' ', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        return f"md5(trim({out}))"

    values = ", ".join(f"({quote(name)}, {quote(t)})" for name, texts in TEXTS.items() for t in texts)
    made = ", ".join(f"({quote(d)}, {quote(name)})" for name, digests in DIGESTS.items() for d in digests)
    return f"""WITH known AS (SELECT {sql("text")} AS digest, license FROM (VALUES {values}) v(license, text) UNION SELECT * FROM (VALUES {made}) w(digest, license)),
whole AS (SELECT doc_id, {sql("text")} AS digest FROM documents),
lines AS (SELECT doc_id, {sql("line")} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
notices AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT doc_id, license FROM lines JOIN known USING (digest)) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, n.notices FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (doc_id)"""
