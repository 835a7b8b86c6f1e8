"""License scans (DataFrame code only): TF-IDF cosine of passages to templates, then directory inheritance.

1. Every file's different words are counted over the whole corpus; words are weighted by tf * idf.
2. A template is compared with every run of its number of words, wherever it begins, so line breaks, comment
   marks and what stands around a notice do not matter; a licence file is compared as a whole as well. A run
   can only reach the threshold if it holds one of some of the template's words, the rarest ones in the
   corpus, without which the rest of its weight stays below the threshold (by Cauchy's inequality). Texts
   are cut into overlapping segments, those with such a word get the idf of their words by a join, and in
   these the regions around the words are looked at.
3. In a region running sums bound the cosine of each run from above (as if no word came twice); where the
   bound reaches the threshold the cosine is computed. The best one gives the file's own licence.
4. Files without a licence of their own take that of the nearest licence file in their directory or an
   ancestor: each distinct directory (not each file) is exploded to its ancestors and joined by path
   with the directories that have a licence file; the longest one wins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Notice templates (licence id, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Licensed under the ISC License"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0"),
    ("MIT", "MIT License"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Fixed value: names of licence files.
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying)([-_.][^/]*)?$"
LEAST_COSINE = 0.75
#: Words of a segment, besides those that the longest template's last run needs.
SEGMENT = 1000


def words(text: Column) -> Column:
    """Lower-cased runs of digits and ASCII letters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def needed_words(weights: dict[str, float], df: dict[str, int], least: float) -> list[str]:
    """The rarest words of a template, without which the others' weight cannot reach a cosine of ``least``."""
    left = total = sum(w * w for w in weights.values())
    out = []
    for word in sorted(weights, key=lambda x: (df[x], -weights[x], x)):
        if left < least * least * total * (1 - 1e-9):
            break
        out.append(word)
        left -= weights[word] ** 2
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` has functions of array elements that refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _segments(ws: Column, longest: int) -> Column:
    """(start, words) of the segments of the array ``ws``; a run of up to ``longest`` words that begins in one lies in it."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(SEGMENT))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(ws, s + 1, SEGMENT + longest - 1).alias("words")))


def _regions(terms: Column, start: Column, length: Column, anchors: list[str], templates: Column) -> Column:
    """For each template the regions of a segment (terms: pos, word, idf) in which runs that hold one of its needed words begin.

    Neighbouring begins are one region; its words carry c, what they add to the dot product with the template."""

    def of(t: Column, hits: Column) -> Column:
        return _let(F.transform(F.filter(hits, lambda h: F.array_contains(t["needed"], h["word"])), lambda h: h["pos"]), lambda at: around(t, at))

    def around(t: Column, at: Column) -> Column:
        first = F.filter(at, lambda p, j: (j == 0) | (p - t["n"] > F.try_element_at(at, j)))
        last = F.filter(at, lambda p, j: (j == F.size(at) - 1) | (F.try_element_at(at, j + 2) - t["n"] > p))
        end = F.least(F.lit(SEGMENT - 1), F.greatest(length - t["n"], F.lit(0)) - start)
        spans = F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.struct(F.greatest(r["a"] - t["n"] + 1, F.lit(0)).alias("lo"), F.least(r["b"], end).alias("hi")))
        own = F.filter(spans, lambda r: r["lo"] <= r["hi"])
        weighed = lambda e: F.struct(e["word"].alias("word"), e["idf"].alias("idf"), (e["idf"] * F.coalesce(F.try_element_at(t["weights"], e["word"]), F.lit(0.0))).alias("c"))
        region = lambda r: F.transform(F.slice(terms, r["lo"] + 1, r["hi"] - r["lo"] + t["n"]), weighed)
        return F.transform(own, lambda r: F.struct(t["license"].alias("license"), t["n"].alias("n"), t["tnorm"].alias("tnorm"), region(r).alias("words")))

    found = F.filter(terms, lambda e: e["word"].isin(*anchors))
    return F.flatten(_let(found, lambda hits: F.transform(templates, lambda t: of(t, hits))))


def _best_run(ws: Column, n: Column, tnorm: Column, least: float) -> Column:
    """The greatest cosine of the runs of ``n`` of the words ``ws`` (word, idf, c) that may reach ``least``; null if none may."""
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))

    def grown(acc: Column, e: Column) -> Column:
        now = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct((now["c"] + e["c"]).alias("c"), (now["s"] + e["idf"] * e["idf"]).alias("s"))))

    def may_reach(b: Column, sums: Column) -> Column:
        lo, hi = F.element_at(sums, b + 1), F.element_at(sums, F.least(b + n, F.size(ws)) + 1)
        return (hi["c"] - lo["c"]) * (hi["c"] - lo["c"]) * (1 + 1e-6) >= least * least * tnorm * tnorm * (hi["s"] - lo["s"])

    every = F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(0)))
    begins = _let(F.aggregate(ws, F.array(zero), grown), lambda sums: F.filter(every, lambda b: may_reach(b, sums)))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0.0).alias("square"), F.lit(0.0).alias("dot"))

    def counted(acc: Column, e: Column) -> Column:
        run = F.when(acc["word"] == e["word"], acc["run"] + 1).otherwise(1)
        return F.struct(e["word"].alias("word"), run.alias("run"), (acc["square"] + e["idf"] * e["idf"] * (2 * run - 1)).alias("square"), (acc["dot"] + e["c"]).alias("dot"))

    exact = lambda b: F.aggregate(F.array_sort(F.slice(ws, b + 1, n)), start, counted, lambda acc: F.round(acc["dot"] / (tnorm * F.sqrt(acc["square"])), 9))
    return F.array_max(F.transform(begins, exact))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """``files`` without the text, with license, how (`own` or `inherited`), cosine and licensed_by (the path it comes from).

    A file's best passage decides its own licence; ties go to the higher cosine, then to the longer template, then to the
    licence first by name. A licence file without a recognised licence passes none on; of several in one
    directory the first path decides. Null and empty texts have no licence of their own but can
    inherit; very long texts are searched whole; a null path inherits nothing. Repeated rows are judged one
    by one. An empty table stays empty. Input columns named like an output column are replaced.
    """
    spark = files.sparkSession
    base = files.drop("license", "how", "cosine", "licensed_by")
    columns = [c for c in base.columns if c != text_col]
    text = files[f"`{text_col}`"]
    path = files[f"`{path_col}`"]
    df = files.select(F.explode(F.array_distinct(words(text))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = materialize(df, "df")
    n_docs = files.count()
    idf = lambda d: F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + d)) + 1
    weights = _templates(spark).join(df, "word", "left").select("template", "license", "n", "word", F.coalesce("df", F.lit(0)).alias("df"), (F.col("tf") * idf(F.coalesce("df", F.lit(0)))).alias("weight"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("tnorm"))
    weights = materialize(weights.join(norms, "template"), "weights")  # as many rows as the templates have words
    of: dict[int, dict] = {}
    known: dict[str, int] = {}
    for r in weights.collect():
        of.setdefault(r.template, {"license": r.license, "n": r.n, "tnorm": r.tnorm, "weights": {}})["weights"][r.word] = r.weight
        known[r.word] = r.df
    for t in of.values():
        t["needed"] = needed_words(t["weights"], known, least)
    anchors = sorted({w for t in of.values() for w in t["needed"]})
    longest = max(t["n"] for t in of.values())
    kind = "array<struct<license:string,n:int,tnorm:double,needed:array<string>,weights:map<string,double>>>"
    templates = F.from_json(F.lit(json.dumps([of[k] for k in sorted(of)])), kind)

    suspect = F.lower(text).rlike(f"(?<![a-z0-9])(?:{'|'.join(map(re.escape, anchors))})(?![a-z0-9])")
    slim = files.select(
        *[files[f"`{c}`"] for c in columns],
        path.alias("__path"),
        F.regexp_replace(path, r"/?[^/]*$", "").alias("__dir"),
        F.when(suspect, words(text)).alias("__words"),
    )
    slim = materialize(slim.withColumn("__row", F.monotonically_increasing_id()), "slim")
    some = slim.where("__words is not null").select("__row", "__path", "__words", F.size("__words").alias("length"))

    pieces = some.select("__row", "length", F.explode(_segments(F.col("__words"), longest)).alias("x")).select("__row", "length", "x.start", "x.words")
    pieces = pieces.where(F.arrays_overlap("words", F.array(*map(F.lit, anchors))))
    terms = pieces.select("__row", "length", "start", F.posexplode("words").alias("pos", "word")).join(df, "word").select("__row", "length", "start", F.struct("pos", "word", idf(F.col("df")).alias("idf")).alias("e"))
    segments = materialize(terms.groupBy("__row", "length", "start").agg(F.array_sort(F.collect_list("e")).alias("terms")), "segments")
    regions = segments.select("__row", F.explode(_regions(F.col("terms"), F.col("start"), F.col("length"), anchors, templates)).alias("r"))
    cosines = regions.select("__row", "r.license", "r.n", _best_run(F.col("r.words"), F.col("r.n"), F.col("r.tnorm"), least).alias("cosine"))

    named = some.where(F.col("__path").rlike(LICENSE_FILE) & (F.col("length") > longest))
    counts = named.select("__row", F.explode("__words").alias("word")).groupBy("__row", "word").agg(F.count("*").alias("n"))
    counts = materialize(counts.join(df, "word").select("__row", "word", (F.col("n") * idf(F.col("df"))).alias("w")), "counts")
    lengths = counts.groupBy("__row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = counts.join(F.broadcast(weights.drop("df")), "word").groupBy("__row", "template", "license", "n", "tnorm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    wholes = dots.join(lengths, "__row").select("__row", "license", "n", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9).alias("cosine"))
    cosines = cosines.unionByName(wholes)
    best = cosines.where(F.col("cosine") >= least).groupBy("__row").agg(F.max_by("license", F.struct("cosine", "n", F.transform(F.split("license", ""), lambda x: -F.ascii(x)))).alias("own"), F.max("cosine").alias("cosine"))
    best = materialize(best.withColumnRenamed("__row", "__r"), "own")
    marked = materialize(slim.drop("__words").join(best, F.col("__row") == F.col("__r"), "left").drop("__row", "__r"), "marked")

    giving = marked.where(F.col("own").isNotNull() & F.col("__path").rlike(LICENSE_FILE)).groupBy(F.col("__dir").alias("from_dir")).agg(F.min(F.struct(F.col("__path").alias("by"), F.col("own").alias("given"))).alias("g"))
    parts = F.split("__dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.when(F.col("__dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    needy = marked.where(F.col("own").isNull() & F.col("__dir").isNotNull()).select("__dir").distinct()
    inherited = needy.select("__dir", F.explode(ancestors).alias("from_dir")).join(giving, "from_dir").groupBy(F.col("__dir").alias("idir")).agg(F.max_by("g", F.length("from_dir")).alias("g"))
    inherited = materialize(inherited.select("idir", "g.by", "g.given"), "inherited")
    full = marked.join(inherited, F.col("__dir") == F.col("idir"), "left")
    own = F.col("own").isNotNull()
    return full.select(
        *[F.col(f"`{c}`") for c in columns],
        F.coalesce("own", "given").alias("license"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").alias("how"),
        F.when(own, F.col("cosine")).alias("cosine"),
        F.when(own, F.col("__path")).otherwise(F.col("by")).alias("licensed_by"),
    )


def _templates(spark: SparkSession) -> DataFrame:
    """(template, license, number of its words, word, tf)."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    each = rows.select("template", "license", F.size(words(F.col("text"))).alias("n"), F.explode(words(F.col("text"))).alias("word"))
    return each.groupBy("template", "license", "n", "word").agg(F.count("*").alias("tf"))
