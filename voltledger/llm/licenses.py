"""Licence scans by canonical digest lookup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key

# The wording of public licences and notices.
LICENSES = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
# Spellings that count as the same word.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("https", "http"), ("v2", "version 2"), ("v3", "version 3")]



_ANY = "|".join(other for other, _ in SPELLINGS)


def _usual(x: Column) -> Column:
    for other, usual in SPELLINGS:
        x = F.regexp_replace(x, rf"(^| ){other}( |$)", f"$1{usual}$2")
    return x


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form: lower case, ASCII punctuation as blanks, no lines that only say whose
    copyright it is, spellings made equal, single blanks, no empty lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"\([cC]\)", "©")), r"[\x00-\x1F !-/:-@\[-`{-~]+", " "))
    lines = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(r"^ ?(copyright|©|all rights reserved)( ©)?( [0-9]| by | ©|$)")))
    lines = F.transform(lines, lambda x: F.trim(F.when(F.regexp_like(x, F.lit(_ANY)), _usual(x)).otherwise(x)))
    return F.filter(lines, lambda x: x != "")


def digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]] = LICENSES) -> DataFrame:
    """digest, license: one row per known text; its size is that of the list given."""
    schema = T.StructType([T.StructField("license", T.StringType()), T.StructField("wording", T.StringType())])
    return spark.createDataFrame(licenses, schema).select(digest(canonical_lines(F.col("wording"))).alias("digest"), "license").dropDuplicates(["digest"])


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text_digest (SHA-256 of the whole canonical text), license (null unless the
    whole text is a known licence), notices (known notices that stand as whole lines, by name, joined by commas; empty
    if none), n_notices (lines found so). Documents that hold nothing but blanks or copyright lines, and null texts,
    have a null digest and match nothing. Repeated rows each get a row."""
    known = F.broadcast(known_digests(docs.sparkSession) if known is None else known.select("digest", "license"))
    lines = docs.select("doc_id", row_key("doc_id", "text").alias("_row"), canonical_lines(F.col("text")).alias("_lines"))
    whole = F.struct(F.lit(True).alias("whole"), F.when(F.size("_lines") > 0, digest(F.col("_lines"))).alias("digest"))
    each = F.transform(F.coalesce("_lines", F.array().cast("array<string>")), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("digest")))
    units = lines.select("doc_id", "_row", F.inline(F.concat(F.array(whole), each))).join(known, "digest", "left").where("whole or license is not null")
    # identical rows meet in one group, and come apart again below
    named = units.groupBy("doc_id", "_row", "whole", "digest", "license").agg(F.count(F.lit(1)).alias("n"))
    of_line = ~F.col("whole")
    rows = named.groupBy("doc_id", "_row").agg(
        F.max(F.when(F.col("whole"), F.struct("n", "digest", "license"))).alias("w"),
        F.array_join(F.array_sort(F.collect_set(F.when(of_line, F.col("license")))), ",").alias("notices"),
        F.coalesce(F.sum(F.when(of_line, F.col("n"))), F.lit(0)).alias("n_notices"),
    )
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w.n"))))
    return rows.select("doc_id", F.col("w.digest").alias("text_digest"), F.col("w.license").alias("license"), "notices", F.expr("n_notices div w.n").alias("n_notices"))
