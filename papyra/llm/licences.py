"""Licence scans in DataFrame functions: TF-IDF cosine of licence statements to templates, and inheritance by directory.

Statements are the lines or sentences of a text that hold a licence word, and the passages that open as a licence text, a header of
several lines or a title does, up to their end. Each is compared with every template; the best one of a document counts if it is near enough. A document without its own statement inherits that of the licence file in its nearest
ancestor directory, by joins on paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, n_words, stored

# Short header statements of public licences.
TEMPLATES = {
    "MIT": "Released under the MIT License. Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense.",
    "CC0-1.0": "Licensed under CC0 1.0 Universal public domain dedication.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Whole texts of the short licences; headers of several lines and titles of the long ones.
PASSAGES = [
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("ISC", _ISC),
    *((f"{k}-{v}", _GNU.format(name, n)) for k, name, v, n in (("GPL", "General Public License", "2.0", "2"), ("GPL", "General Public License", "3.0", "3"), ("LGPL", "Lesser General Public License", "3.0", "3"), ("AGPL", "Affero General Public License", "3.0", "3"))),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: How passages open and end; a passage without its end goes on to the end of the text. Comment signs may stand between words.
PASSAGE = "(?is)" + "|".join(
    x.replace(" ", r"[\s*#/;%-]+")
    for x in (
        r"permission is hereby granted, free of.*?(?:dealings in the software|\z)",
        r"redistribution and use in source.*?(?:possibility of such damage|\z)",
        r"permission to use, copy, modify,.*?(?:performance of this software|\z)",
        r"is free software\b.*?(?:\.(?=\s|\z)|\z)",
        r"licensed under the apache license\b.*?(?:\.(?=\s|\z)|\z)",
        r"gnu (?:lesser |library |affero )?general public license,? version [0-9.]*[0-9]",
        r"(?:apache|mozilla public) license,? (?:version|v\.) ?[0-9.]*[0-9]",
    )
)
SPDX = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)"
MARK = r"(?i)licen[cs]e|SPDX|public domain|copyright"
#: Statements that say that a licence does not hold.
DENIED = r"(?i)\b(?:not|never|no longer|isn't|aren't)\s+(?:\w+\s+){0,2}(?:licen[cs]ed|released|distributed|published|available|covered|offered|under)\b"
#: Texts are cut into statements at line ends and behind sentence ends.
CUT = r"[\r\n]+|(?<=[.!?;|])\s+(?=\p{Lu})"
TERM = r"[a-z]+[a-z0-9-]*|[0-9]+(?:\.[0-9]+)*"
LEAST = 0.6


def _terms(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def scanned(docs: DataFrame, key: str, path: str | None, text: str) -> DataFrame:
    """(id, path, lines, tags) of each row: the licence statements of its text that deny nothing, and its SPDX identifiers. The one pass over the texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    said = F.filter(F.split(body, CUT, -1), lambda s: s.rlike(MARK))
    lines = F.filter(F.concat(said, F.regexp_extract_all(body, F.lit(PASSAGE), F.lit(0))), lambda s: ~s.rlike(DENIED))
    none = F.expr("cast(array() as array<string>)")
    tags = F.regexp_extract_all(body, F.lit(SPDX), F.lit(1))
    marked = body.rlike(MARK)
    where = F.col(path) if path else F.lit(None)
    return docs.select(F.col(key).alias("id"), where.cast("string").alias("path"), F.when(marked, lines).otherwise(none).alias("lines"), F.when(marked, tags).otherwise(none).alias("tags"))


def _templates(spark) -> DataFrame:
    """(tid, licence, line), as literals."""
    rows = [F.struct(F.lit(k).alias("tid"), F.lit(name).alias("licence"), F.lit(line).alias("line")) for k, (name, line) in enumerate(sorted([*TEMPLATES.items(), *PASSAGES]))]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def _best(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best")).select(key, "best.licence", (-F.col("best.minus")).alias("score"))


def nearest_templates(found: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, licence, score) from scanned(): the nearest template of each id's statements, if its cosine is at least `least`; a licence named by SPDX scores 1.

    Inverse document frequencies cover all statements and templates. Ties go to the first licence by name.
    """
    templates = _templates(found.sparkSession)
    lines = stored(found.select("id", F.explode("lines").alias("line")).withColumn("sid", F.xxhash64("line")))
    # equal statements are compared once, however many documents hold them
    distinct = stored(lines.groupBy("sid").agg(F.min("line").alias("line"), F.count("*").alias("n")))
    tf = stored(distinct.select("sid", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("sid", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n")))
    ttf = templates.select("tid", "licence", F.explode(_terms(F.col("line"))).alias("term")).groupBy("tid", "licence", "term").agg(F.count("*").alias("tf"))
    total = int(distinct.agg(F.sum("n")).first()[0] or 0) + len(TEMPLATES) + len(PASSAGES)  # one number
    df = tf.select("term", "n").union(ttf.select("term", F.lit(1).cast("long"))).groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", (1 + F.log(F.lit(1 + total) / (1 + F.col("df")))).alias("idf"))
    # the licence words themselves stand in every statement
    weighted = stored(looked_up(tf, idf, ["term"]).select("sid", "term", (F.col("tf") * F.col("idf")).alias("w")))
    tweighted = ttf.join(idf, "term").select("tid", "licence", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    norm = weighted.groupBy("sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tnorm = tweighted.groupBy("tid").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    dot = weighted.join(F.broadcast(tweighted), "term").groupBy("sid", "tid", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))  # a row a term of a template
    cosine = dot.join(norm, "sid").join(F.broadcast(tnorm), "tid").select("sid", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("score"))
    best = stored(_best(cosine, "sid").where(F.col("score") >= least))
    names = F.create_map(*[F.lit(x) for k in TEMPLATES for x in (k.lower(), k)])
    licence = F.try_element_at(names, F.regexp_replace(F.lower("tag"), r"(?:-only|-or-later|\+)$", ""))
    tagged = found.select("id", F.explode("tags").alias("tag")).select("id", licence.alias("licence"), F.lit(1.0).alias("score")).where("licence is not null")
    near = looked_up(lines.select("id", "sid"), best, ["sid"]).where("licence is not null")  # one statement may stand in a third of all texts
    return _best(near.select("id", "licence", "score").union(tagged), "id")


def licensed(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", licence_file: str = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$") -> DataFrame:
    """Per row of files: its id, path, licence, score and origin (own, inherited or none), and licence_dir for inherited ones.

    A licence file's directory passes its licence on to all below that have no nearer one; of several files of a directory the best statement, then
    the first licence by name, counts. Null paths and texts have nothing to inherit or to say; rows of equal id share their statements, rows without id have none.
    Other columns are ignored. An empty table gives an empty result.
    """
    found = stored(scanned(files, key, path, text))
    own = stored(nearest_templates(found))
    named = stored(found.select("id", "path").join(own, "id", "left"))
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    dirs = named.where(F.col("path").rlike(licence_file) & F.col("licence").isNotNull()).groupBy(folder(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("d"))
    dirs = dirs.select("dir", F.col("d.licence").alias("dir_licence"), (-F.col("d.minus")).alias("dir_score"))
    # one row for each distinct directory, then for each of its ancestors
    below = named.where("licence is null and path is not null").select(folder(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    ups = below.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("dir")).distinct()
    nearest = ups.join(dirs, "dir").groupBy("folder").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "dir_licence", "dir_score")).alias("up"))
    out = looked_up(named.withColumn("folder", F.when(F.col("licence").isNull(), folder(F.col("path")))), nearest, ["folder"])
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", F.coalesce("licence", "up.dir_licence").alias("licence"), F.coalesce("score", "up.dir_score").alias("score"), origin.alias("origin"), F.when(origin == "inherited", F.col("up.dir")).alias("licence_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files, a demonstration, as the table has no paths: source/lang/doc_id.txt; a text of which licence statements are the larger part is its source's LICENSE-doc_id."""
    said = F.filter(F.split("text", CUT, -1), lambda s: s.rlike(MARK))
    is_file = F.col("text").rlike(MARK) & (2 * n_words(F.array_join(said, " ")) > n_words(F.col("text")))
    name = F.when(is_file, F.concat_ws("/", "source", F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string")))).otherwise(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", name.alias("path"))


def licences(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, path, licence, score, origin, licence_dir. Ties, null and empty texts and repeated rows as in licensed()."""
    return licensed(document_paths(docs)).withColumnRenamed("id", "doc_id")
