"""License scans by sparse TF-IDF cosine, and inheritance from the nearest directory.

Templates are notices, SPDX lines and the texts of licences (of the long ones their heads).
Words are weighed by term frequency and by an inverse document frequency counted over every
word of all documents.  The rarest words of a template that no match can do without are its
anchors: wherever two of them stand in a document about as far apart as in the template, the
passage of the template's length that they align with is held against it by cosine.  Equal passages are scored once.  A
document of which a licence's passage makes up FILE_SHARE of the words is a licence file; it
speaks for its directory and all below it that have none nearer.

DataFrame functions only.
"""

from __future__ import annotations

import json
import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Licences and the wording of their notices and texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied."""),
    ("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,
REPRODUCTION, AND DISTRIBUTION 1. Definitions."""),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person
or organization obtaining a copy of the software and accompanying documentation covered by this license"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means."""),
    ("CC0-1.0", "CC0 1.0 Universal Creative Commons Legal Code"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
)
#: SPDX identifiers; each makes a template of its own.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Names under which licences are mentioned in passing.
NAMES = (
    ("AGPL-3.0", ("AGPL v3", "AGPLv3", "AGPL-3.0", "Affero General Public License")), ("Apache-2.0", ("Apache", "Apache 2.0", "Apache-2.0", "Apache Software")),
    ("BSD-2-Clause", ("BSD 2-Clause", "BSD-2-Clause", "2-clause BSD", "Simplified BSD", "FreeBSD")),
    ("BSD-3-Clause", ("BSD 3-Clause", "BSD-3-Clause", "3-clause BSD", "New BSD", "Modified BSD")), ("BSL-1.0", ("Boost Software", "BSL-1.0")),
    ("EPL-2.0", ("EPL 2.0", "EPL-2.0", "Eclipse Public")), ("GPL-2.0", ("GPL v2", "GPLv2", "GPL-2.0", "GPL version 2", "General Public License v2")),
    ("GPL-3.0", ("GPL v3", "GPLv3", "GPL-3.0", "GPL version 3", "General Public License v3")), ("ISC", ("ISC",)),
    ("LGPL-2.1", ("LGPL v2.1", "LGPLv2.1", "LGPL-2.1")), ("LGPL-3.0", ("LGPL v3", "LGPLv3", "LGPL-3.0")), ("MIT", ("MIT", "MIT/X11", "Expat")),
    ("MPL-2.0", ("MPL 2.0", "MPL v2.0", "MPLv2", "MPL-2.0", "Mozilla Public License 2.0")), ("Unlicense", ("The Unlicense",)), ("Zlib", ("zlib", "zlib/libpng")),
)
#: How such a name stands in a sentence.
MENTIONS = ("{} License", "{} Licence", "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "license: {}", "GNU {}")
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
COSINE, FILE_SHARE = 0.75, 0.1
#: Words by which anchors may be shifted against each other.
SHIFT = 2
#: Parts of each row in joins on what many rows share.
SALTS = 16
ANCHOR_SCHEMA = "map<string, array<struct<t: int, o: int, l: int, mates: array<struct<d: int, term: string>>>>>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def directory() -> Column:
    """Directory of a document of the corpus: its source, its language and 64 neighbours by id."""
    return F.concat_ws(
        "/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.floor(F.col("doc_id") / 64).cast("string"), F.lit("-"))
    )


def ancestors(path: Column) -> Column:
    """The directory itself and all above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def all_templates() -> list[tuple[str, list[str]]]:
    """Licence and words of every template."""
    named = [(name, plain_words(wording)) for name, wording in TEMPLATES]
    spdx = [(x, plain_words(f"SPDX-License-Identifier: {x}")) for x in SPDX]
    mentioned = [(name, tuple(plain_words(m.format(x)))) for name, forms in NAMES for x in forms for m in (*MENTIONS, "{}") if m != "GNU {}" or "GPL" in name]
    # a mention has two words at least: a single one is found by cosine wherever it stands
    return named + spdx + [(name, list(w)) for name, w in dict.fromkeys(mentioned) if len(w) > 1]


def weights_of(template: list[str], df: dict[str, int], n: int) -> dict[str, float]:
    """Term frequency times inverse document frequency of a template's words."""
    return {x: template.count(x) * (log((n + 1.0) / (df.get(x, 0) + 1.0)) + 1.0) for x in sorted(set(template))}


def anchors_of(template: list[str], df: dict[str, int], n: int, cosine: float) -> list[tuple[str, int]]:
    """The anchors of a template that occur in documents at all, and where they stand in it first.

    By Cauchy and Schwarz a passage that lacks words of a share 1 - cosine^2 of the template's
    squared weights stays below the cosine.  The rarest words that hold more than that share,
    even without the heaviest of them, are the anchors: a match has at least two of them.  A
    template whose words that occur at all hold less than a share cosine^2 has no match.
    """
    weights = weights_of(template, df, n)
    if sum(w * w for x, w in weights.items() if df.get(x)) < cosine * cosine * sum(w * w for w in weights.values()):
        return []
    needed, held, heaviest, found = (1 - cosine * cosine) * sum(w * w for w in weights.values()), 0.0, 0.0, []
    for x in sorted(weights, key=lambda x: (df.get(x, 0), x)):
        found.append(x)
        held += weights[x] ** 2
        heaviest = max(heaviest, weights[x] ** 2)
        if held - heaviest > needed:
            break
    return [(x, template.index(x)) for x in found if df.get(x)]


def anchor_map(templates: list[tuple[str, list[str]]], df: dict[str, int], n: int, cosine: float) -> dict[str, list[dict]]:
    """By anchor: template, place in it, its length, and the other anchors with their distance."""
    found: dict[str, list[dict]] = {}
    for t, (_, template) in enumerate(templates):
        mine = anchors_of(template, df, n, cosine)
        for w, o in mine if len(mine) > 1 else []:
            mates = [{"d": p - o, "term": x} for x, p in mine if x != w]
            found.setdefault(w, []).append({"t": t, "o": o, "l": len(template), "mates": mates})
    return found


def passages(w: Column, anchors: dict[str, list[dict]]) -> Column:
    """array<struct<t, words>>: the passages of a document's words that anchors align with a template."""
    kind = "array<struct<t: int, words: array<string>>>"
    if not anchors:
        return F.array().cast(kind)
    known = F.from_json(F.lit(json.dumps(anchors)), ANCHOR_SCHEMA)
    names = sorted(anchors)

    def near(s: Column, a: Column) -> Column:
        def stands(m: Column) -> Column:
            first = F.greatest(s["p"] + m["d"] - SHIFT, F.lit(1))
            return F.array_contains(F.slice(w, first, F.greatest(s["p"] + m["d"] + SHIFT - first + 1, F.lit(0))), m["term"])

        return F.exists(a["mates"], stands)

    def aligned(s: Column) -> Column:
        return F.transform(F.filter(known[s["x"]], lambda a: near(s, a)), lambda a: F.struct(a["t"].alias("t"), (s["p"] - a["o"]).alias("b"), a["l"].alias("l")))

    def cut(z: Column) -> Column:
        first = F.greatest(z["b"], F.lit(1))
        return F.struct(z["t"].alias("t"), F.slice(w, first, z["b"] + z["l"] - first).alias("words"))

    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("p"))), lambda s: s["x"].isin(names))
    places = F.array_distinct(F.flatten(F.transform(hits, aligned)))
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, names))), F.array_distinct(F.transform(places, cut))).otherwise(F.array().cast(kind))


def salted(df: DataFrame) -> DataFrame:
    """Each row in SALTS parts, to be joined by sorting: its size is not known before it is exploded."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def licences(docs: DataFrame, folder: Column | None = None, cosine: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """doc_id, path, license, score, origin and license_path of every row of docs(doc_id, text, source, lang).

    origin is own (a passage of the document matches), inherited (the nearest directory above
    holds a licence file) or none; license_path is the document's directory or the one it
    inherits from.  score is the cosine, to four digits.  Ties go to the longer template,
    then to the first licence by name; between licence files of a directory to the higher
    score, then the first name.  Null and empty texts have no passage but inherit; repeated
    rows are returned as they come; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    templates = all_templates()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (directory() if folder is None else folder).alias("path"))
    # how many documents hold each word; words are summed before they move
    held = written(rows.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    n = rows.count()
    # a fixed number of rows
    vocabulary = sorted({w for _, t in templates for w in t})
    df = {r.term: r.df for r in held.where(F.col("term").isin(vocabulary)).collect()}
    profile = []
    for t, (_, template) in enumerate(templates):
        w = weights_of(template, df, n)
        length = sum(v * v for v in w.values()) ** 0.5
        profile += [(t, x, v / length) for x, v in w.items()]
    weights = F.broadcast(spark.createDataFrame(profile, "t int, term string, tw double"))
    names = F.broadcast(spark.createDataFrame([(t, name, len(w)) for t, (name, w) in enumerate(templates)], "t int, license string, l int"))

    spoken = rows.withColumn("w", words(F.col("text"))).select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "path", F.size("w").alias("n_words"), passages(F.col("w"), anchor_map(templates, df, n, cosine)).alias("found")
    )
    spoken = written(spoken, "passages")  # from here on _row is fixed
    said = spoken.where(F.size("found") > 0).select("_row", "n_words", F.explode("found").alias("f")).select(
        "_row", "n_words", "f.t", "f.words", F.md5(F.concat_ws(" ", F.lit(""), "f.words").cast("binary")).alias("pid")
    )
    distinct = said.groupBy("pid", "t").agg(F.first("words").alias("words"))
    tf = distinct.select("pid", "t", F.explode("words").alias("term")).groupBy("pid", "t", "term").agg(F.count("*").alias("tf"))
    tf = written(tf, "tf")
    # words that many passages share are spread over SALTS parts
    every = salted(held.join(tf.select("term").distinct(), "term", "left_semi"))
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    weighed = tf.withColumn("_salt", F.pmod(F.xxhash64("pid", "t"), F.lit(SALTS)).cast("int")).join(every, ["term", "_salt"], "left")
    weighed = weighed.withColumn("w", F.col("tf") * idf).join(weights, ["t", "term"], "left")
    scored = weighed.groupBy("pid", "t").agg(
        F.round(F.sum(F.col("w") * F.coalesce("tw", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w"))), 4).alias("score")
    )
    good = written(scored.where(F.col("score") >= cosine).join(names, "t"), "scored")
    mine = said.select("_row", "n_words", "pid", "t", F.size("words").alias("said"), F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("_salt"))
    best = F.struct((-F.col("score")).alias("o"), (-F.col("l")).alias("z"), F.col("license").alias("license"))
    own = mine.join(salted(good), ["pid", "t", "_salt"]).groupBy("_row").agg(
        F.min(best).alias("b"), F.max("said").alias("said"), F.first("n_words").alias("n")
    ).select("_row", F.col("b.license").alias("license"), (-F.col("b.o")).alias("score"), (F.col("said") >= file_share * F.col("n")).alias("file"))
    found = written(spoken.select("_row", "doc_id", "path").join(own, "_row", "left"), "own")
    discard(held, spoken, tf, good)
    files = found.where("file").groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("o"), "license")).alias("f")).select(
        F.col("path").alias("dir"), F.col("f.license").alias("dir_license"), (-F.col("f.o")).alias("dir_score")
    )
    # every directory finds the nearest licence file once; documents then join their own directory
    folders = found.select("path").distinct()
    above = folders.select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    given = above.join(files, "dir").groupBy("path").agg(F.max(F.struct(F.length("dir").alias("o"), "dir", "dir_license", "dir_score")).alias("g"))
    dealt = found.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int"))
    has = F.col("license").isNotNull()
    return dealt.join(salted(given), ["path", "_salt"], "left").select(
        "doc_id", "path",
        F.coalesce("license", "g.dir_license").alias("license"),
        F.when(has, F.col("score")).otherwise(F.col("g.dir_score")).alias("score"),
        F.when(has, "own").when(F.col("g.dir").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("g.dir")).alias("license_path"),
    )
