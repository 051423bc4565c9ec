"""License scans: sparse TF-IDF cosine to templates and inheritance from the nearest directory,
with DataFrame functions only.

A file is read as lines and sentences, and as sentences whose wraps are undone:
from every start of a line or sentence up to PIECES lines or sentences of the
paragraph are joined, without comment marks, and cut after as many sentences as a
template has at most.  A licence file is read as a whole too, and compared with
whole licence texts, which go before single statements.  Words of
templates weigh by the inverse document frequency over all files; any other
word weighs as one that a single file has.  A sentence (or whole licence file)
whose cosine to a template reaches the threshold states that licence; a file's
licence is its best statement (ties: the first template name).  Such a unit can
only reach the threshold if it holds one of a template's leading words: without
them the template's remaining weight is below it.  So units without any
leading word are passed over, without loss.

A file that states none takes the licence of a licence file in its own
directory, or else in the nearest directory above that has one.

Defined results: null or empty texts state nothing; null paths have no
directory and inherit nothing; repeated rows are given one result each; of
several licence files in a directory the best cosine, then the first path, counts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import let, stored

THRESHOLD = 0.8
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|copyright|unlicense|notice)([._-].*)?$"

# Statements by which files name or grant a licence (public licence notices).
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
]
_MIT_REST = (" The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
             "the Software. ")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
          "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
          "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
          "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
          "SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission. ")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
              "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
              "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
              "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
              "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
              "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
              "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GRANT = next(t for _, t in TEMPLATES if t.endswith("subject to the following conditions:"))
# Whole licence texts, compared with whole licence files.
LICENCE_TEXTS = [
    ("MIT", "MIT License Copyright (c) " + _GRANT + _MIT_REST + _AS_IS),
    ("BSD-2-Clause", "Copyright (c) All rights reserved. " + _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", "Copyright (c) All rights reserved. " + _BSD + _BSD_THIRD + _BSD_AS_IS),
]
PIECES = 20  # the longest template in lines of 30 characters
_PIECE_END = r"\n|(?<=[.!?:])[^\S\n]+"
_COMMENT_MARK = (r"^\s*(?:#+|/\*+|//+!?|\*+/?|;+|--+|%+|<!--|\"{3}|'{3}|\.\.(?=\s)|(?i:rem|dnl)(?=\s))?\s*"
                 r"|\s*(?:\*+/|-->)?\s*$")


def template_words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+", text)]


def words(text: Column) -> Column:
    """Lower-cased words: runs of letters, or numbers with their points."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:\.[0-9]+)*|\p{L}+"), F.lit(0))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (),
         templates: list[tuple[str, str]] = TEMPLATES,
         licence_texts: list[tuple[str, str]] = LICENCE_TEXTS) -> DataFrame:
    """(keep..., path, license, stated, similarity, license_path): ``stated`` tells whether the file names its
    licence itself; ``similarity`` is the cosine of the deciding statement; ``license_path`` is the licence file
    that an inherited licence comes from."""
    spark = files.sparkSession
    rows = files.select(*[files[c] for c in keep], files[path_col].cast("string").alias("path"),
                        files[text_col].cast("string").alias("text"))
    bags = [(k, name, template_words(t)) for k, (name, t) in enumerate([*templates, *licence_texts])]
    n_sentences = max([len(re.split(r"(?<=[.!?:])\s+", t)) for _, t in templates], default=1)
    vocabulary = sorted({w for _, _, ws in bags for w in ws})
    known = F.array(*[F.lit(w) for w in vocabulary])
    # Document frequencies over all files; one row per template word comes back.
    n = files.count()
    df = dict(rows.where(F.col("text").isNotNull())
              .select(F.explode(F.array_intersect(F.array_distinct(words(F.col("text"))), known)).alias("w"))
              .groupBy("w").count().collect())
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    other = math.log((1 + n) / 2) + 1
    weights, leading = [], set()
    for k, name, ws in bags:
        tf = {w: ws.count(w) * idf[w] for w in set(ws)}
        norm = math.sqrt(sum(v * v for v in tf.values()))
        weights += [(k, name, k >= len(templates), w, v / norm) for w, v in tf.items()]
        if k >= len(templates):
            continue  # compared with whole files only, which are not passed over
        left = 1.0
        for w in sorted(tf, key=lambda w: (-tf[w], w)):
            if left < THRESHOLD ** 2 - 1e-9:
                break
            leading.add(w)
            left -= (tf[w] / norm) ** 2
    template = F.broadcast(spark.createDataFrame(weights, "k int, license string, for_whole boolean, word string, weight double"))
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    some = r"(?i)(?<![\p{L}0-9])(?:" + "|".join(sorted(map(re.escape, leading))) + r")(?![\p{L}0-9])"

    def joined(ps: Column, marked: Column) -> Column:
        """Units with wraps undone, from every piece that has a leading word in reach."""
        def start(at: Column) -> Column:
            reach = F.transform(F.slice(ps, at + 1, F.lit(PIECES)), lambda p: F.when(p == "", "\n").otherwise(p))
            paragraph = F.substring_index(F.array_join(reach, " "), "\n", 1)
            return let(F.split(paragraph, r"(?<=[.!?:])\s+"), lambda ss: F.array(
                *[F.array_join(F.slice(ss, F.lit(1), F.lit(k)), " ") for k in range(1, n_sentences + 1)]))
        near = F.filter(F.sequence(F.lit(0), F.size(ps) - 1),
                        lambda at: F.array_contains(F.slice(marked, at + 1, F.lit(PIECES)), True))
        return F.filter(F.flatten(F.transform(near, start)), lambda s: s.rlike(some))

    name = F.element_at(F.split("path", "/"), -1)
    is_licence = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(""))
    sentences = F.filter(F.split(text, r"\n|(?<=[.!?:])\s+"), lambda s: s.rlike(some))
    none = F.array().cast("array<string>")
    pieces = let(F.transform(F.split(text, _PIECE_END), lambda p: F.regexp_replace(p, _COMMENT_MARK, "")),
                 lambda ps: let(F.transform(ps, lambda p: p.rlike(some)), lambda marked: joined(ps, marked)))
    units = F.array_distinct(F.concat(sentences, F.when(text.rlike(some), pieces).otherwise(none)))
    units = F.concat(F.transform(units, lambda s: F.struct(s.alias("unit"), F.lit(False).alias("whole"))),
                     F.transform(F.when(is_licence, F.array(text)).otherwise(none),
                                 lambda s: F.struct(s.alias("unit"), F.lit(True).alias("whole"))))
    # Files with equal path and text give equal results, so they are scanned once.
    unit = (rows.select("path", F.xxhash64("text").alias("th"), F.explode(units).alias("x")).distinct()
            .select("path", "th", F.xxhash64("x.unit", "x.whole").alias("u"), "x.unit", "x.whole"))
    counted = (unit.select("path", "th", "u", "whole", F.explode(words(F.col("unit"))).alias("word"))
               .groupBy("path", "th", "u", "whole", "word").agg(F.count("*").alias("tf"))
               .join(idfs, "word", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(other))))
    counted = stored(counted.select("path", "th", "u", "whole", "word", "v"), "licence-words")
    norms = counted.groupBy("path", "th", "u").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = counted.join(template, "word").where(F.col("whole") | ~F.col("for_whole")) \
        .groupBy("path", "th", "u", "k", "license", "for_whole") \
        .agg(F.sum(F.col("v") * F.col("weight")).alias("dot"))
    key = [F.col("path").eqNullSafe(F.col("p")), F.col("th") == F.col("t"), F.col("u") == F.col("nu")]
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    stated = (dots.join(norms.select(F.col("path").alias("p"), F.col("th").alias("t"), F.col("u").alias("nu"), "norm"), key)
              .withColumn("similarity", cosine).where(F.col("similarity") >= THRESHOLD)
              .groupBy("path", "th").agg(F.min(F.struct(~F.col("for_whole"), (-F.col("similarity")).alias("s"), "license")).alias("best"))
              .select("path", "th", F.col("best.license").alias("license"), (-F.col("best.s")).alias("similarity")))
    stated = stored(stated, "licences-stated")

    # Directories: their own licence, else that of the nearest directory above.
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    own = (stated.where(is_licence).groupBy(directory.alias("at"))
           .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("own")))
    dirs = rows.where(F.col("path").isNotNull()).select(directory.alias("dir")).distinct()
    up = dirs.select("dir", let(F.split("dir", "/"), lambda parts: F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(
            d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("at")))).alias("up"))
    above = up.select("dir", F.explode("up").alias("a")).select("dir", "a.depth", "a.at").distinct()
    inherited = (above.join(own, "at").groupBy("dir").agg(F.max_by(F.struct("own.license", "own.path", "own.s"), "depth").alias("i"))
                 .select("dir", F.col("i.license").alias("from_license"), F.col("i.path").alias("license_path"),
                         (-F.col("i.s")).alias("from_similarity")))
    out = rows.withColumns({"th": F.xxhash64("text"), "dir": directory}).drop("text")
    out = out.join(stated.select(F.col("path").alias("p"), F.col("th").alias("t"), "license", "similarity"),
                   F.col("path").eqNullSafe(F.col("p")) & (F.col("th") == F.col("t")), "left").join(inherited, "dir", "left")
    is_stated = F.col("license").isNotNull()
    return out.select(*keep, "path", F.coalesce("license", "from_license").alias("license"), is_stated.alias("stated"),
                      F.coalesce("similarity", "from_similarity").alias("similarity"),
                      F.when(~is_stated, F.col("license_path")).alias("license_path"))
