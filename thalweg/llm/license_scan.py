"""Operator 10: license scans, in DataFrame operations alone.

Lines that may state a licence are compared with one-sentence templates by the
cosine of sparse TF-IDF vectors. The whole text and windows of its words about
each mark, in sizes from a title to the longest licence, are compared likewise
with FORMS: full texts, headers and short statements, so that wrapped, inlined
and full texts count. A form of many words wins over a line, a line or an SPDX
identifier over a short statement within other words. A file without a statement of
its own inherits that of the nearest directory above it that has a licence file:
its ancestors are joined with the licensed directories by path, and the longest
path wins.

A licence file is one named so, or one of which at least half of the words are
a statement. Weights come from the templates or forms, so a line scores alike whatever
else the table holds; a word of no template weighs as much as one of a single
template.

Defined results: null and empty texts state nothing; a null path is the top
directory; ties go to the first licence by name; repeated rows get a row each,
and alike; a text of any length is split into its lines and words in one row;
extra columns, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statements of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions of the BSD License are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under the Creative Commons Attribution ShareAlike license, CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    "Proprietary": "Copyright. All rights reserved",
    "Public-Domain": "This work is released into the public domain, CC0",
}
# Parts of words that every statement has one of.
MARKS = ("icense", "icence", "ICENSE", "opyright", "OPYRIGHT", "ublic domain", "ights reserved", "reative ", "CC BY", "CC0", "ermitted provided")
LICENSE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
COSINE = 0.7

# Longer forms; the full texts of further licences lie in the folder `licenses`.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."
_LONG = [
    ("MIT", _MIT),
    ("BSD-3-Clause", _BSD.format(third=_THIRD)),
    ("BSD-2-Clause", _BSD.format(third="")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Public-Domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *((f"{'L' if name else ''}GPL-{v if '.' in v else v + '.0'}", _GNU.format(what="library" if name else "program", colon=":" if v == "3" else ";", name=name, version=v)) for name, v in (("", "2"), ("", "3"), ("Lesser", "2.1"), ("Lesser", "3"))),
]
_SHORT = [
    *TEMPLATES.items(),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("MIT", "distributed under the terms of the MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
FULL_TEXTS = Path(__file__).parent / "licenses"
# of a text that is whole or a window
FORM_COSINE = 0.8
# words that a window is laid about, window sizes (each 1.6 times the one before), and windows that a word lies in
MARK_WORDS = "^(licen[cs]|copyright|cc0?$|public$|rights$|creative$|permitted$|permission$)"
SIZES = (5, 8, 13, 21, 33, 53, 85, 136, 218, 349, 558, 893, 1429, 2286, 3657, 5852)
OVERLAP = 4
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"
SPDX_NAMES = {"CC0-1.0": "Public-Domain", "Unlicense": "Public-Domain"}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def template_weights(spark: SparkSession) -> DataFrame:
    """(word, license, weight): unit TF-IDF vectors of the templates, and idf of each word."""
    rows = spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")
    terms = rows.select("license", F.explode(_words(F.col("text"))).alias("word")).groupBy("license", "word").agg(F.count("*").alias("tf"))
    idf = terms.groupBy("word").agg((F.log(F.lit(1.0 + len(TEMPLATES)) / F.count("*")) + 1).alias("idf"))
    terms = terms.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norms = terms.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return terms.join(norms, "license").select("word", "license", "idf", (F.col("w") / F.col("norm")).alias("weight"))


def forms() -> list[tuple[int, str, bool, str]]:
    """(form, license, whether it has many words, text)."""
    full = [(f.stem, f.read_text("utf-8")) for f in sorted(FULL_TEXTS.glob("*.txt"))]
    return [(i, name, i < len(full) + len(_LONG), text) for i, (name, text) in enumerate(full + _LONG + _SHORT)]


def form_weights(spark: SparkSession) -> tuple[DataFrame, int]:
    """(form, license, long, word, idf, weight): unit vectors of the forms, and how many forms there are.

    A word's count weighs by its logarithm, and words of all forms weigh next to nothing.
    """
    rows = forms()
    terms = spark.createDataFrame(rows, "form int, license string, long boolean, text string").select("form", "license", "long", F.explode(_words(F.col("text"))).alias("word"))
    terms = terms.groupBy("form", "license", "long", "word").agg((1 + F.log(F.count("*"))).alias("tf"))
    idf = terms.groupBy("word").agg(F.log(F.lit(1.0 + len(rows)) / F.count("*")).alias("idf"))
    terms = terms.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norms = terms.groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return terms.join(norms, "form").select("form", "license", "long", "word", "idf", (F.col("w") / F.col("norm")).alias("weight")), len(rows)


def windows(files: DataFrame) -> DataFrame:
    """Of files (row, text), the whole text and windows about marks of which at least half of the words are in forms: row, at, size, said."""
    vocabulary = sorted({w for *_, text in forms() for w in re.split(r"[^a-z0-9]+", text.lower()) if w})
    some = ", ".join(f"'{w}'" for w in vocabulary)
    texts = files.select("row", _words(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    texts = texts.withColumn("inside", F.expr(f"transform(words, w -> w in ({some}))")).withColumn("marks", F.expr(f"filter(sequence(0, n - 1), i -> words[i] rlike '{MARK_WORDS}')"))
    spans = ["array(named_struct('at', 0, 'size', n))"]
    for size in SIZES:
        step = -(-size // OVERLAP)
        spans.append(f"if(n > {size}, array_distinct(flatten(transform(marks, p -> transform(sequence(0, {OVERLAP - 1}), j -> named_struct('at', greatest(0, int(p / {step}) - j) * {step}, 'size', {size}))))), array())")
    texts = texts.withColumn("spans", F.expr(f"concat({', '.join(spans)})"))
    texts = texts.withColumn("spans", F.expr("filter(spans, x -> 2 * size(filter(slice(inside, x.at + 1, x.size), y -> y)) >= least(x.size, n - x.at))"))
    return texts.select("row", F.explode(F.expr("transform(spans, x -> named_struct('at', x.at, 'size', x.size, 'said', slice(words, x.at + 1, x.size)))")).alias("x")).select("row", "x.*")


def form_statements(files: DataFrame) -> DataFrame:
    """Of files (row, text), the forms that the whole text or a window of it is like: row, license, score, said, rank."""
    weights, n = form_weights(files.sparkSession)
    weights = F.broadcast(weights)  # as many rows as the forms have words
    idf = F.broadcast(weights.select("word", "idf").distinct())
    keys = ["row", "at", "size"]
    terms = windows(files).select(*keys, F.explode("said").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    weighed = terms.join(idf, "word", "left").withColumn("w", (1 + F.log("n")) * F.coalesce("idf", F.log(F.lit(1.0 + n)))).drop("idf")
    norms = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("said"))
    scores = weighed.join(weights, "word").groupBy(*keys, "form", "license", "long").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = scores.join(norms, keys).withColumn("score", F.round(F.least(F.lit(1.0), F.col("dot") / F.col("norm")), 6))
    return scores.filter(F.col("score") >= FORM_COSINE).select("row", "license", "score", "said", F.when(F.col("long"), 2).otherwise(0).alias("rank"))


def identifiers(files: DataFrame) -> DataFrame:
    """Of files (row, text), the licences of their SPDX identifiers: row, license, score, said, rank."""
    names = F.explode(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(SPDX), 1), lambda x: F.split(F.regexp_replace(x, r"\bWITH[ \t]+[^ \t()]+", ""), r"[() \t]+"))))
    found = files.filter(F.contains("text", F.lit("SPDX-License-Identifier:"))).select("row", names.alias("name"))
    found = found.select("row", F.regexp_replace("name", r"(-only|-or-later|\+)$", "").alias("license")).filter((F.col("license") != "") & ~F.col("license").isin("AND", "OR", "WITH"))
    for spdx, name in SPDX_NAMES.items():
        found = found.withColumn("license", F.when(F.col("license") == spdx, name).otherwise(F.col("license")))
    return found.select("row", "license", F.lit(1.0).alias("score"), F.size(F.split("license", "[^A-Za-z0-9]+")).cast("bigint").alias("said"), F.lit(1).alias("rank"))


def statements(files: DataFrame) -> DataFrame:
    """Of files (row, text, named), the best statement of each: license, score, and whether the file is a licence file."""
    spark = files.sparkSession
    some = F.lit(False)
    for m in MARKS:
        some = some | F.contains("text", F.lit(m))
    files = files.filter(some | F.col("named")).dropDuplicates(["row"])
    lines = files.select("row", "named", F.posexplode(F.split("text", r"\R")).alias("line", "said"))
    some = F.lit(False)
    for m in MARKS:
        some = some | F.contains("said", F.lit(m))
    lines = lines.filter(some | F.col("named"))
    terms = lines.select("row", "line", F.explode(_words(F.col("said"))).alias("word")).groupBy("row", "line", "word").agg(F.count("*").alias("tf"))
    weights = F.broadcast(template_weights(spark))  # as many rows as TEMPLATES has words
    idf = weights.select("word", "idf").distinct()
    unseen = F.log(F.lit(1.0 + len(TEMPLATES))) + 1
    weighed = terms.join(F.broadcast(idf), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    norms = weighed.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("said"))
    scores = weighed.drop("idf").join(weights, "word").groupBy("row", "line", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = scores.join(norms, ["row", "line"]).select("row", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"), "said").filter(F.col("score") >= COSINE).withColumn("rank", F.lit(1))
    scores = scores.unionByName(form_statements(files)).unionByName(identifiers(files))
    best = scores.groupBy("row").agg(F.max(F.struct("rank", "score", "said")).alias("top"), F.min(F.struct((-F.col("rank")).alias("r"), (-F.col("score")).alias("s"), F.col("license"))).alias("first"))
    sizes = files.select("row", F.size(_words(F.col("text"))).alias("n"), "named")
    return best.join(sizes, "row").select("row", F.col("first.license").alias("license"), F.col("top.score").alias("score"), (F.col("named") | (2 * F.col("top.said") >= F.col("n"))).alias("whole"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path") -> DataFrame:
    """key, license, score, origin ('stated', 'inherited' or 'none'), directory of files (key, path, text)."""
    at = F.coalesce(F.col(path).cast("string"), F.lit(""))
    parent = F.regexp_replace(at, r"/?[^/]*$", "")
    files = files.select(F.col(key).cast("bigint").alias("key"), "text", at.alias("path"), parent.alias("dir"), F.xxhash64(F.col(key), F.col(path), F.col("text")).alias("row"))
    found = statements(files.select("row", "text", F.col("path").rlike(LICENSE_NAMES).alias("named"))).checkpoint()
    slim = files.select("key", "dir", "row")
    own = slim.join(found, "row", "left")
    # of several licence files of one directory the best statement counts
    licensed = slim.join(found.filter("whole"), "row").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("top")).select("dir", F.col("top.license").alias("dir_license"), (-F.col("top.s")).alias("dir_score"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = slim.select("dir").distinct().select(F.col("dir").alias("below"), F.explode(above).alias("dir")).distinct()
    nearest = dirs.join(licensed, "dir").groupBy("below").agg(F.max_by(F.struct("dir", "dir_license", "dir_score"), F.length("dir")).alias("near")).select(F.col("below").alias("dir"), "near")
    out = own.join(nearest, "dir", "left")
    stated, near = F.col("license").isNotNull(), F.col("near")
    return out.select(
        F.col("key").alias(key),
        F.coalesce("license", near["dir_license"]).alias("license"),
        F.coalesce("score", near["dir_score"]).alias("score"),
        F.when(stated, "stated").when(near.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~stated, near["dir"]).alias("directory"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")))
