"""Licence scans: TF-IDF cosine of headers and licence files to licence templates, then inheritance from the nearest ancestor directory.

Candidates of every file are its lines, the sentences of its lines, its leading block (the lines before the first blank one, joined) and, of files named
like licence files, the whole text. Their terms are lower-cased runs of letters, digits and dots, weighed by inverse document frequencies
that are counted over all files. A file's own licence is the template of the highest cosine over its candidates, if that reaches ``threshold``.
A candidate is no statement of a template where the words that tell licences of a family apart differ (AFFERO, NC ...), where it lacks a version number of the
template, where it denies more often than the template, or where the template of another licence is as near (within MARGIN): it then has none rather than a neighbour's.
Candidates without any of the seeds can't reach it (by the Cauchy-Schwarz bound on what is left of each template), so only files that
hold a seed are cut up.

A licence file is one whose own licence stands in its first line that isn't blank, in its leading block or in its whole text, or that is named like one
(LICENSE, COPYING ...); it speaks for its directory and all below that have none nearer. Files without a licence of their own take that of the nearest
ancestor directory: the distinct directories, each with its few ancestors, are joined by path to those that have one.

Null and empty texts have no own licence, null paths no directory. Ties: the template listed first, and in a directory the licence file of
the highest cosine, then of the smallest path. Equal texts have one own licence, whole if one of them is named like a licence file. Repeated rows are files
each. Very long texts are read whole. Other columns than path, text and those of ``carry`` are ignored; a carried column with the name of a
result column gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Licence statements (fixed values: public headers and notices of the licences).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-rights-reserved", "All rights reserved."),
    ("All-rights-reserved", "Copyright (c) 2000 Company. All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
]
#: Names of licence files.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$"

#: Words that tell one licence of a family from another: those of a candidate must be those of its template (fixed values).
QUALIFIERS = ["affero", "lesser", "noncommercial", "noderivatives", "noderivs", "sharealike", "endorse"]
#: Those that do so right behind CC BY only (fixed values).
CC_QUALIFIERS = r"(?:^| )cc by((?: nc)?(?: sa| nd)?)(?= |$)"
#: Words that deny: a candidate has no more of them than its template (fixed values).
DENIALS = ["not", "never", "isn", "cannot"]
#: A version number, of a template or a candidate.
VERSION = r"^v?[0-9]{1,2}([.][0-9]{1,2})*$"
#: By how much the best licence's cosine must be over any other's for one candidate.
MARGIN = 0.01

_BREAK = r"[^\p{L}\p{N}.]+|\.+(?=\P{N}|$)"


def words(text: Column) -> Column:
    """Lower-cased terms; a dot stays only within a number such as 2.0."""
    return F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")


def _qualifiers(terms: Column) -> Column:
    """The words that tell a licence from its neighbours, sorted; those of CC as one."""
    return F.array_append(F.array_sort(F.array_distinct(F.filter(terms, lambda w: w.isin(QUALIFIERS)))), F.regexp_extract(F.array_join(terms, " "), CC_QUALIFIERS, 1))


def parent(path: Column) -> Column:
    """The directory of a path; that of ``/a`` is ``/``, and ``/`` has none."""
    head = F.regexp_replace(path, "/[^/]*$", "")
    return F.when((path == "/") | ~path.contains("/"), None).when(head == "", "/").otherwise(head)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, df): in how many texts each term stands."""
    return texts.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _vectors(frequencies: DataFrame, total: int, templates: list[tuple[str, str]]) -> tuple[list[tuple[str, dict[str, float]]], dict[str, int]]:
    """Unit vectors of the templates, and in how many files their terms stand."""
    spark = frequencies.sparkSession
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(templates)], "template int, license string, text string")
    split = [(r["template"], r["license"], r["w"]) for r in rows.select("template", "license", words(F.col("text")).alias("w")).collect()]  # templates only
    vocabulary = spark.createDataFrame([(w,) for w in sorted({w for *_, ws in split for w in ws})], "term string")
    counts = {r["term"]: r["df"] for r in frequencies.join(F.broadcast(vocabulary), "term").collect()}  # a row for each term of the templates
    vectors = []
    for _, name, ws in sorted(split):
        vector = {w: ws.count(w) * (math.log((1 + total) / (1 + counts.get(w, 0))) + 1) for w in ws}
        size = math.sqrt(sum(v * v for v in vector.values()))
        vectors.append((name, {w: v / size for w, v in vector.items()}))
    return vectors, counts


def _marks(spark, templates: list[tuple[str, str]]) -> list[tuple]:
    """(template, license, versions, qualifiers, denials) of each template."""
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(templates)], "template int, license string, text string").withColumn("w", words(F.col("text")))
    told = rows.select("template", "license", F.array_distinct(F.filter("w", lambda x: x.rlike(VERSION))), _qualifiers(F.col("w")), F.size(F.filter("w", lambda x: x.isin(DENIALS))))
    return [tuple(r) for r in told.collect()]  # templates only


def _seeds(vectors: list[tuple[str, dict[str, float]]], counts: dict[str, int], threshold: float) -> list[str]:
    """Terms of which a candidate must have one to reach the threshold with any template: those of each that the fewest files have, until the rest can't."""
    seeds: set[str] = set()
    for _, vector in vectors:
        rest = sum(v * v for w, v in vector.items() if w not in seeds)
        for w, v in sorted(vector.items(), key=lambda x: (counts.get(x[0], 0), -x[1], x[0])):
            if rest < (threshold - 1e-6) ** 2:
                break
            if w not in seeds:
                seeds.add(w)
                rest -= v * v
    return sorted(seeds)


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.6, carry: tuple[str, ...] = (), any_header: bool = False) -> DataFrame:
    """path, the columns of carry, own_license, own_cosine, license, inherited_from (a directory, null if own or none) and levels (directories up).

    files: (path, text, the columns of carry). any_header: every file with a licence of its own speaks for its directory, for tables whose paths name no
    licence files.
    """
    spark = files.sparkSession
    carry = tuple(c for c in carry if c not in ("path", "text", "own_license", "own_cosine", "license", "inherited_from", "levels"))
    named = F.coalesce(F.regexp_extract(F.col("path").cast("string"), "([^/]*)$", 1).rlike(FILE_NAMES), F.lit(False))
    rows = files.select(F.col("path").cast("string").alias("path"), *(F.col(c).alias(f"carried_{c}") for c in carry), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), named.alias("named"))
    frequencies = stored(document_frequencies(rows))
    total = rows.count()
    vectors, counts = _vectors(frequencies, total, templates)
    seeds = F.array(*(F.lit(w) for w in _seeds(vectors, counts, threshold)))
    # each row of a few templates and their terms
    weights = spark.createDataFrame([(w, i, v) for i, (_, vector) in enumerate(vectors) for w, v in vector.items()], "term string, template int, weight double")
    names = F.create_map(*(x for i, (name, _) in enumerate(vectors) for x in (F.lit(i), F.lit(name))))

    # the text itself stands for its licence: equal texts are scanned once
    texts = rows.select(F.xxhash64("text", F.lit(1)).alias("t1"), F.xxhash64("text", F.lit(2)).alias("t2"), "text", "named").where(F.arrays_overlap(words(F.col("text")), seeds))
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    of_lines = F.flatten(F.transform(lines, lambda x, i: F.transform(F.array_distinct(F.concat(F.array(x), F.split(x, r"(?<=[.;!?])\s+"))), lambda y: F.struct(y.alias("body"), (i == 0).alias("first")))))
    leading = F.regexp_extract("text", r"(?s)^\s*(.*?)(\r?\n[ \t]*\r?\n|$)", 1)
    whole = F.when(F.col("named"), F.array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(of_lines, F.transform(F.concat(F.array(leading), whole), lambda y: F.struct(y.alias("body"), F.lit(True).alias("first")))))
    units = texts.select("t1", "t2", F.explode(units).alias("u")).select("t1", "t2", "u.first", words(F.col("u.body")).alias("terms")).where(F.arrays_overlap("terms", seeds))
    units = units.select("t1", "t2", "first", _qualifiers(F.col("terms")).alias("own_qualifiers"), F.array_sort("terms").alias("terms")).groupBy("t1", "t2", "terms", "own_qualifiers").agg(F.max("first").alias("first"))
    units = stored(units.select("t1", "t2", F.xxhash64("terms", "own_qualifiers").alias("unit"), "first", "terms", "own_qualifiers"))
    # frequencies of the templates' terms, which all candidates share, go to the rows; the rows of other terms go to their frequencies
    common = spark.createDataFrame([(w, n) for w, n in counts.items()], "term string, df long")
    counted = units.select("t1", "t2", "unit", "first", F.explode("terms").alias("term")).groupBy("t1", "t2", "unit", "first", "term").agg(F.count("*").alias("tf"))
    told = counted.join(F.broadcast(common), "term", "left")
    weighed = told.where("df is not null").unionByName(told.where("df is null").drop("df").join(frequencies, "term")).withColumn("w", F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1))
    norms = weighed.groupBy("t1", "t2", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(weights), "term").groupBy("t1", "t2", "unit", "first", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    near = dots.join(norms, ["t1", "t2", "unit"]).withColumn("cosine", cosine).where(F.col("cosine") >= threshold)
    # what tells licences apart must agree
    kinds = spark.createDataFrame(_marks(spark, templates), "template int, license string, versions array<string>, qualifiers array<string>, denials int")
    own = units.select("t1", "t2", "unit", "terms", "own_qualifiers")
    fits = (F.col("own_qualifiers") == F.col("qualifiers")) & (F.size(F.array_except("versions", "terms")) == 0) & (F.size(F.filter("terms", lambda w: w.isin(DENIALS))) <= F.col("denials"))
    stated = near.join(own, ["t1", "t2", "unit"]).join(F.broadcast(kinds), "template").where(fits)
    each = stated.groupBy("t1", "t2", "unit", "license").agg(F.max(F.struct("cosine", -F.col("template"), "first")).alias("b"))
    clear = each.groupBy("t1", "t2", "unit").agg(F.max("b").alias("b"), F.sort_array(F.collect_list("b.cosine"), asc=False).alias("cosines"))  # one for each licence
    best = clear.where((F.size("cosines") < 2) | (F.get("cosines", F.lit(0)) - F.get("cosines", F.lit(1)) >= MARGIN)).groupBy("t1", "t2").agg(F.max("b").alias("b"))
    best = stored(best.select("t1", "t2", F.col("b.cosine").alias("own_cosine"), names[-F.col("b.col2")].alias("own_license"), F.col("b.first").alias("first")))

    held = [f"carried_{c}" for c in carry]
    found = rows.select("path", *held, "named", F.xxhash64("text", F.lit(1)).alias("t1"), F.xxhash64("text", F.lit(2)).alias("t2")).join(best, ["t1", "t2"], "left").drop("t1", "t2").withColumn("dir", parent(F.col("path")))
    found = stored(found)
    speaks = found.where(F.col("own_license").isNotNull() & (F.lit(any_header) | F.col("first") | F.col("named"))).where("dir is not null")
    declared = speaks.groupBy("dir").agg(F.min(F.struct(-F.col("own_cosine"), "path", "own_license")).alias("d")).select(F.col("dir").alias("above"), F.col("d.own_license").alias("given"))
    # a directory and its ancestors, nearest first
    parts = F.split(F.col("dir"), "/")
    ancestors = found.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - F.when(F.col("dir") == "/", 2).otherwise(1)), lambda k: F.when(F.size(parts) - k <= 1, F.when(F.col("dir").startswith("/"), F.lit("/")).otherwise(F.col("dir"))).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - k), "/")))).alias("levels", "above"))
    nearest = ancestors.join(declared, "above").groupBy("dir").agg(F.min(F.struct("levels", "above", "given")).alias("n")).select("dir", "n.*")
    own = F.col("own_license").isNotNull()
    return found.join(nearest, "dir", "left").select("path", *(F.col(f"carried_{c}").alias(c) for c in carry), "own_license", "own_cosine", F.coalesce("own_license", "given").alias("license"), F.when(~own, F.col("above")).alias("inherited_from"), F.when(~own, F.col("levels")).alias("levels"))
