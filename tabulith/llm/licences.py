"""Licence scan by canonical digests.

A text is lower-cased, its copyright lines are dropped, punctuation becomes space, equivalent spellings become one,
and the digest of what is left is looked up among the digests of known licence texts, normalised the same way. The
whole text of a document is looked up by a hash join, and so is every line of it, because short notices stand on a line
of their own. Only entire texts match: a licence quoted within a line does not.

DataFrame functions only. Null text, or text without a letter or digit, has no digest and no licence. Rows are scanned
one by one, so repeated rows and null ids stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

# fixed values: licence texts and notices, as published
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n")
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n")
LICENCES = (
    ("MIT", _MIT + _WARRANTY_MIT),
    ("MIT", "MIT License\n" + _MIT + _WARRANTY_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted.\n" + _WARRANTY_ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: digests of longer published texts, as ``whole_digest`` gives them
DIGESTS = (
    ("Apache-2.0", "4f8caa9a32c00fbc0b82aa9c4bec85c3"), ("GPL-2.0", "bc956f44d1c84837504c207f245fa68b"),
    ("GPL-3.0", "472144077ff4d35f29cc80d05d62b4af"), ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-2.0", "0d0c617863ffeb16c5cb1f094c2d68b2"), ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
)
#: fixed values: equivalent spellings, after punctuation has become space
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("programme", "program"), ("judgement", "judgment"), ("fulfilment", "fulfillment"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"),
)

#: a line that starts like a copyright statement, with the line break before it
_COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: the wrapped line of a licence that starts like one
_WRAPPED = r"(^|\n)([ \t*#/;-]*)(copyright)(?=[ \t]+(notice|notices|holder|holders|owner|owners|law|laws|license|licence)\b)"
#: ASCII that is no letter, digit or line break
_MARKS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"


def normalised(text: Column) -> Column:
    """The text's lines in canonical form, still apart."""
    # a mark before such a line's first word keeps it; it goes with the other marks
    kept = F.regexp_replace(F.lower(text), _WRAPPED, "$1$2_$3")
    out = F.regexp_replace(F.regexp_replace(kept, _COPYRIGHT, "$1"), _MARKS, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def whole_digest(lines: Column) -> Column:
    whole = F.trim(F.regexp_replace(lines, "[ \n]+", " "))
    return F.when(whole != "", F.md5(whole))


def known_digests(spark: SparkSession, licences=LICENCES) -> DataFrame:
    """``known_digest, name``: one row per digest."""
    rows = spark.createDataFrame(list(licences), "name string, text string")
    found = rows.select(whole_digest(normalised(F.col("text"))).alias("known_digest"), "name")
    if licences is LICENCES:
        found = found.union(spark.createDataFrame([(d, n) for n, d in DIGESTS], "known_digest string, name string"))
    return found.where(
        "known_digest is not null").groupBy("known_digest").agg(F.min("name").alias("name"))


def scan(docs: DataFrame, licences=LICENCES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, license, line_licenses`` of every row: the digest of the whole text, the licence it is, and the
    sorted licences that lines of it are, null and empty where there are none."""
    known = known_digests(docs.sparkSession, licences)
    # as many as the texts in the code: the lines look their digests up in a literal map
    every = F.create_map(*(F.lit(x) for r in known.collect() for x in r))
    rows = docs.select(F.col(key).alias("doc_id"), normalised(F.col(text)).alias("lines")).select(
        "doc_id", whole_digest(F.col("lines")).alias("digest"), F.split("lines", "\n").alias("lines"))
    rows = rows.join(F.broadcast(known), F.col("digest") == F.col("known_digest"), "left")
    names = F.transform("lines", lambda x: F.try_element_at(every, F.md5(F.trim(x))))
    return rows.select("doc_id", "digest", F.col("name").alias("license"), F.coalesce(
        F.array_sort(F.array_distinct(F.array_compact(names))), F.array().cast("array<string>")).alias("line_licenses"))


def _sql() -> str:
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    def lines(text):
        out = f"regexp_replace(regexp_replace(lower({text}), {quoted(_COPYRIGHT)}, '\\1', 'g'), {quoted(_MARKS)}, ' ', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quoted(old)}, {quoted(new)})"
        return out

    def digest(text):
        return f"case when trim(regexp_replace({text}, '[ \n]+', ' ', 'g')) <> '' then md5(trim(regexp_replace({text}, '[ \n]+', ' ', 'g'))) end"

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in LICENCES)
    return f"""
with texts as (select name, {lines('t')} as t from (values {values}) v(name, t)),
known as (select {digest('t')} as d, min(name) as name from texts group by 1),
docs as (select row_number() over () as r, doc_id, {lines('text')} as t from documents),
hits as (select r, list_sort(list(distinct k.name)) as l from (select r, unnest(string_split(t, '\n')) as x from docs) u
  join known k on k.d = md5(trim(u.x)) group by r)
select d.doc_id, {digest('d.t')} as digest, k.name as license, coalesce(h.l, []) as line_licenses
from docs d left join known k on k.d = {digest('d.t')} left join hits h on h.r = d.r
"""


@query("op9_license_digests", _sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
