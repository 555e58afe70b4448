"""License scan: sparse TF-IDF cosine to templates, then inheritance down the directories.

Every line of every text is a possible license header, and so is every run of
words of a grant's length, across line breaks; every whole text is a possible
licence file.  Each becomes the counts of its terms, weighted by how rare a term
is among all documents.  Its cosine to each template, a short grant or a full
licence text, is a sum over shared terms (sparse: what has no such terms has no
rows; what cannot reach the threshold with the template terms that it holds is
left out before).  The best template of a document's headers and whole text at
``threshold`` or more is its own license.  A document that is a license as a
whole, or little else than its header, is a licence file and speaks for its
directory; documents without a license of their own inherit from the nearest
ancestor directory that has one, by joining their ancestor paths to the
licence files' directories.

The templates are small fixed tables, given as arguments or ``TEMPLATES`` (short
grants) and ``TEXTS`` (full texts); term weights come from all documents.
DataFrame operations only.

Defined cases: null and empty texts have no license of their own and may
inherit; a null path has no directory and inherits nothing; of several licence
files of a directory the best score counts, then the smallest id; ties of
templates go to the first name; rows that repeat an id are one document; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.lineage import materialize

#: License names and the wording of their short grants.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: License names and full texts of licence files.
TEXTS = [
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
     "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
     "the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission. " + _DISCLAIMER),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
     "specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
     "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
     "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
     "<https://www.gnu.org/licenses/>."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
     "authors of this software dedicate any and all copyright interest in the software to the public domain."),
]
THRESHOLD = 0.7
#: A document is a licence file if it has at most this many words beside its header.
FILE_WORDS = 40
#: Words that start a run at a time; the rows that hold them have a grant's length more.
PIECE = 512


def pieces_of(text: Column) -> Column:
    return F.split(F.lower(text), r"[^a-z0-9.\-]+|[.]+(?=\s|$)")


def terms(text: Column) -> Column:
    return F.filter(pieces_of(text), lambda t: t != "")


def fixed_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table, written into the plan."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def held_terms(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id, held): the words of the templates that each text holds, written once; texts without any have no row."""
    known = F.array_distinct(F.filter(pieces_of(F.col("text")), lambda t: t.isin(vocabulary)))
    held = docs.select("id", F.explode(F.array(known)).alias("held"))  # made once, not again in the filter
    return materialize(held.filter(F.size("held") > 0), "license-terms")


def document_frequency(held: DataFrame) -> dict[str, int]:
    """Number of documents that hold each word of the templates; a row per template word."""
    words = held.select(F.explode("held").alias("term"))
    return {r["term"]: r["n"] for r in words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}


def deciding_terms(vectors: dict, threshold: float, idf: dict[str, float] | None = None) -> list[str]:
    """Terms without which nothing reaches the threshold.

    What holds only a template's commonest terms cannot come closer than
    their share of the template's length; as many as stay below the threshold
    decide nothing, and all others do.  Commonest by ``idf`` (or by weight)."""
    out: set[str] = set()
    for vector in vectors.values():
        squares, all_squares = 0.0, sum(w * w for w in vector.values())
        for term, w in sorted(vector.items(), key=lambda t: ((idf or vector)[t[0]], t[0])):
            squares += w * w
            if squares >= threshold * threshold * all_squares * 0.999:
                out.add(term)
    return sorted(out)


def may_reach(held: Column, vectors: dict, threshold: float) -> Column:
    """Whether the terms of some template that are held make up enough of its length: the cosine cannot be more."""
    def share(vector: dict[str, float]) -> Column:
        total = sum(w * w for w in vector.values())
        squares = F.create_map(*[F.lit(x) for t, w in vector.items() for x in (t, w * w / total)])
        shared = F.array_intersect(held, F.array(*[F.lit(t) for t in vector]))
        return F.aggregate(shared, F.lit(0.0), lambda a, t: a + F.element_at(squares, t))

    return F.greatest(F.lit(0.0), *[share(v) for v in vectors.values()]) >= threshold * threshold * 0.999


def runs(docs: DataFrame, grants: dict, threshold: float, idf: dict[str, float]) -> DataFrame:
    """(id, doc_words, terms): runs of words, of each grant's length, that may reach the threshold to it."""
    sizes: dict[int, dict] = {}
    for key, (size, vector) in grants.items():
        sizes.setdefault(size, {})[key] = vector
    deciding = F.array(*[F.lit(t) for t in deciding_terms({k: v for k, (_, v) in grants.items()}, threshold, idf)])
    pieces = docs.select("id", "doc_words", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("terms") - 1, F.lit(PIECE)),
        lambda k: F.slice("terms", k + 1, PIECE + max(sizes) - 1))).alias("piece"))
    hits = pieces.select("id", "doc_words", "piece", F.posexplode("piece").alias("p", "term")).filter(
        F.array_contains(deciding, F.col("term")))
    n, p = F.size("piece"), F.col("p")

    def around(size: int, vectors: dict) -> Column:
        deciding = F.col("term").isin(deciding_terms(vectors, threshold, idf))
        starts = F.when((n >= size) & deciding, F.sequence(F.greatest(F.lit(0), p - size + 1), F.least(p, n - size)))
        found = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda k: F.slice("piece", k + 1, size))
        return F.filter(found, lambda run: may_reach(run, vectors, threshold))

    return hits.select("id", "doc_words", F.explode(F.concat(*[around(k, v) for k, v in sizes.items()])).alias("terms"))


def own_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                 texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """(id, license, score, is_file) of the documents (id, text) with a header or a whole text that is a license."""
    spark = docs.sparkSession
    numbered = [(k, name, wording) for k, (name, wording) in enumerate([*templates, *texts])]
    counted = fixed_table(spark, numbered, ["template", "license", "wording"]).select(
        "template", F.explode(terms(F.col("wording"))).alias("term")).groupBy("template", "term").agg(
        F.count(F.lit(1)).alias("tf")).collect()  # the fixed table
    vocabulary = sorted({r["term"] for r in counted})
    held = held_terms(docs, vocabulary)
    total, df = docs.count(), document_frequency(held)
    idf = {w: math.log((total + 1.0) / (df.get(w, 0) + 1.0)) + 1.0 for w in vocabulary}
    rarest = math.log(total + 1.0) + 1.0  # weight of a term that no template knows: it counts in a line's length
    vectors: dict[int, dict[str, float]] = {}
    for r in counted:
        vectors.setdefault(r["template"], {})[r["term"]] = r["tf"] * idf[r["term"]]
    grants = {k: (sum(r["tf"] for r in counted if r["template"] == k), v) for k, v in vectors.items() if k < len(templates)}
    norm = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in vectors.items()}
    side = fixed_table(spark, [(k, numbered[k][1], t, w / norm[k]) for k, v in vectors.items() for t, w in v.items()],
                       ["template", "license", "term", "template_w"])
    # only texts that may reach the threshold are split into terms a second time
    able = materialize(held.filter(may_reach(F.col("held"), vectors, threshold)).select("id").distinct(), "license-able")
    wholes = docs.join(able, "id", "left_semi").select(
        "id", "text", F.size(F.split(F.trim("text"), r"\s+")).alias("doc_words"), terms(F.col("text")).alias("terms"))
    wholes = materialize(wholes, "license-texts")
    lines = (wholes.select("id", "doc_words", F.explode(F.split("text", r"\n")).alias("line"))
             .select("id", "doc_words", terms(F.col("line")).alias("terms")).filter(may_reach(F.col("terms"), vectors, threshold)))
    rows = lines.unionByName(runs(wholes, grants, threshold, idf)).withColumn("rest", F.col("doc_words") - F.size("terms"))
    rows = rows.unionByName(wholes.select("id", "doc_words", "terms", F.lit(0).alias("rest")))
    rows = materialize(rows.withColumn("unit", F.sha2(F.array_join("terms", " "), 256)), "license-units")
    counts = (rows.select("unit", "terms").dropDuplicates(["unit"]).select("unit", F.explode("terms").alias("term"))
              .groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf")))
    weights = fixed_table(spark, list(idf.items()), ["term", "idf"])
    weighed = (counts.join(F.broadcast(weights), "term", "left")  # one row per template word
               .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rarest))))
    length = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = (weighed.join(F.broadcast(side), "term").groupBy("unit", "template", "license")
              .agg(F.sum(F.col("w") * F.col("template_w")).alias("dot")).join(length, "unit")
              .select("unit", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
              .filter(F.col("score") >= threshold))
    top = F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("top")
    names = scored.groupBy("unit").agg(top).select("unit", "top")
    found = rows.join(names, "unit").select("id", "top", "rest")
    return (found.groupBy("id").agg(F.min("top").alias("top"), F.min("rest").alias("rest"))
            .select("id", F.col("top.license").alias("license"), (-F.col("top.minus")).alias("score"),
                    (F.col("rest") <= FILE_WORDS).alias("is_file")))


def ancestors(path: Column) -> Column:
    """A path's directories with their depth, the nearest last: a/b/c -> a, a/b."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when((path.isNotNull()) & (depth > 0), F.transform(
        F.sequence(F.lit(1), depth), lambda d: F.struct(F.array_join(F.slice(parts, 1, d), "/").alias("dir"), d.alias("depth"))))


def license_scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text",
                 templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                 texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """(id, own_license, own_score, license, inherited_from, depth): one row per document.

    ``path``: the document's place, directories separated by "/"."""
    docs = df.select(F.col(id_col).alias("id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = materialize(own_licenses(docs, templates, threshold, texts), "own-licenses")
    places = materialize(docs.groupBy("id").agg(F.min("path").alias("path")), "places")
    rows = places.join(own, "id", "left")
    at = F.when(F.instr("path", "/") > 0, F.expr("substring_index(path, '/', size(split(path, '/')) - 1)"))
    files = (rows.filter("is_file").withColumn("dir", at).filter("dir is not null").groupBy("dir")
             .agg(F.min(F.struct((-F.col("score")).alias("minus"), "id", "license")).alias("top"))
             .select("dir", F.col("top.id").alias("file"), F.col("top.license").alias("dir_license")))
    # directories are few against documents: each is matched to its nearest licence file once
    dirs = rows.withColumn("dir", at).select("dir").filter("dir is not null").distinct()
    nearest = (dirs.select(F.col("dir").alias("own_dir"), F.explode(ancestors(F.concat("dir", F.lit("/")))).alias("a"))
               .select("own_dir", F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth")).join(files, "dir")
               .groupBy("own_dir").agg(F.max(F.struct("depth", "file", "dir_license")).alias("near")))
    nearest = materialize(nearest, "nearest")
    out = rows.withColumn("own_dir", at).join(nearest, "own_dir", "left")
    inherits = F.col("license").isNull()
    return out.select("id", F.col("license").alias("own_license"), F.col("score").alias("own_score"),
                      F.coalesce("license", "near.dir_license").alias("license"),
                      F.when(inherits, F.col("near.file")).alias("inherited_from"),
                      F.when(inherits, F.col("near.depth")).alias("depth"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in corpus/<source>/<language>/<id>, the only places that the table tells."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.lit("corpus"), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")),
                       F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = license_scan(docs, path)
    return out.withColumnRenamed("id", "doc_id").withColumn("depth", F.col("depth").cast("int"))
