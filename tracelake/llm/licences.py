"""Operator 8: licence scans, in DataFrame operations only.

1. document frequencies: how many files hold a term, over the whole texts of all files (combined map-side);
2. templates of notices, headers and licence texts become sparse TF-IDF vectors, unit by unit of a file:
   - every line, by cosine: a line that is a notice;
   - every window of four lines (one before, two after), and the file's head of ``HEAD`` lines, by the share of a template's
     squared weight that they hold: names, years, other sentences and wrapping take nothing from that, so that headers and
     inline notices are found;
   - the whole file, by cosine: a licence file, if the template is the text of a licence, or the file nothing but the notice;
   A unit that says "not" where the template does not is prose about a licence, and three words of a notice among many others
   are prose as well, unless a copyright stands beside them. Of templates with one score the heavier wins: a header of the lesser
   licence holds all words of the greater one's, and its own besides;
3. inheritance: a licence file, by its vector or its name, speaks for its directory; files below it that name no licence
   themselves take that of the nearest ancestor directory, by joining ancestors' paths.

Which lines are looked at follows from the threshold: a template's rarest terms are set aside until what is left of it weighs
less than ``LEAST_COSINE`` of the whole; a vector without any of these terms cannot reach that cosine, nor a window hold
``LEAST_HELD``. Lines and windows without such a term are passed over without loss, whatever they say.

Templates, and directories with the licence they take, are broadcast after they are counted; whatever follows the files is
joined by sorting. A directory keeps one licence (the best score, then the first path) and looks up its ancestors once, so
that a directory with a third of all files is one row until its files meet the answer.

Defined cases: null text is an empty text (no licence of its own); a null path has no ancestors; a null id stays null and
neither gives nor takes a licence; repeated rows get the same answer, rows with one id and another text one each; empty
tables give an empty result; other columns are ignored. Among licences of one file the best score wins, then the heavier template, then the first name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialize

#: Least cosine of a line or a file and a template.
LEAST_COSINE = 0.6
#: Least share of a template's squared weight in a window of lines.
LEAST_HELD = 0.9
BROADCAST_ROWS = 100_000
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|copyright|unlicense|notice)[^/]*$"
# Terms that turn a notice into its opposite, unless it has them itself.
NEGATIONS = ["not", "never", "isn't", "wasn't", "weren't", "aren't", "cannot", "neither", "nor"]
#: Notices of so few terms say nothing among many others, unless a copyright stands beside them; so many others are let pass.
SHORT, OTHERS = 3, 2
#: Cosine from which a file says nothing but a notice.
NOTHING_ELSE = 0.99
#: Lines of a file's head.
HEAD = 20
# Notices by licence.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
# Texts of licences, or their heads; a file near one of them is a licence file, and speaks for its directory.
TEXTS = [
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
]


TEMPLATES = NOTICES + TEXTS


def templates(spark: SparkSession) -> DataFrame:
    """(template, licence, notice, is_text)"""
    rows = [(i, a, b, i >= len(NOTICES)) for i, (a, b) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, licence string, notice string, is_text boolean")


#: What holds of a whole template.
OF_TEMPLATE = ["template", "licence", "tnorm", "size", "negated", "is_text"]


def _terms(text: F.Column) -> F.Column:
    # "CC BY" is one term: a "by" elsewhere in a window says nothing
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\bcc by\b", "cc-by"), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), 0)


def _counts(df: DataFrame, keys: list[str], terms: F.Column) -> DataFrame:
    return df.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg((1 + F.log(F.count("*"))).alias("tf"))


def weighed(rows: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, idf) of all terms in rows(body), and notices as (template, licence, term, tw, tnorm, sign): sign marks the rarest
    terms, without any of which no vector comes near."""
    of_text = rows.select(F.explode(F.array_distinct(_terms(F.col("body")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    of_text = materialize(of_text, "licence-terms")
    n = float(rows.count())
    idf = of_text.select("term", F.log(F.lit(1.0) + F.lit(n) / F.col("df")).alias("idf"))
    terms = _terms(F.col("notice"))
    notices = notices.select("template", "licence", "is_text", "notice", F.size(F.array_distinct(terms)).alias("size"), _negated(terms).alias("negated"))
    counts = _counts(notices, ["template", "licence", "is_text", "size", "negated"], terms)
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    known = idf.join(counts, "term", "right").select("template", "licence", "is_text", "size", "negated", "term", (F.col("tf") * F.coalesce("idf", F.log(F.lit(1.0 + n)))).alias("tw"))
    whole, rarest = Window.partitionBy("template"), Window.partitionBy("template").orderBy(F.desc("tw"), "term")
    known = known.withColumn("tnorm", F.sqrt(F.sum(F.col("tw") * F.col("tw")).over(whole)))
    before = F.sum(F.col("tw") * F.col("tw")).over(rarest) - F.col("tw") * F.col("tw")
    left = F.col("tnorm") * F.col("tnorm") - before  # what weighs as much as this term or less
    return idf, materialize(known.withColumn("sign", F.sqrt(F.greatest(left, F.lit(0.0))) >= (LEAST_COSINE - 1e-6) * F.col("tnorm")), "licence-templates")


def _negated(terms: F.Column) -> F.Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, NEGATIONS)))


def _stands(size: F.Column, beside: F.Column, says_no: F.Column) -> F.Column:
    """Whether a template can be meant: a unit with a negation that the template lacks does not mean it, nor does one of many
    terms mean a short one, but beside a copyright."""
    return (~says_no | F.col("negated")) & ((F.col("size") > SHORT) | beside | (size <= F.col("size") + OTHERS))


def _cosines(units: DataFrame, keys: list[str], idf: DataFrame, known: DataFrame) -> DataFrame:
    """(keys, of the template, score) of units(keys, terms) and the templates near them."""
    vector = _counts(units, keys, F.col("terms")).join(idf, "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w"))
    vector = materialize(vector, "licence-vectors")
    norms = vector.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vector.join(known, "term").groupBy(*keys, *OF_TEMPLATE).agg((F.sum(F.col("w") * F.col("tw")) / F.col("tnorm")).alias("dot"))
    return dots.join(norms.hint("merge"), keys).select(*keys, *OF_TEMPLATE, F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= LEAST_COSINE)


def scan(files: DataFrame, notices: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """files(id, path, text), notices(template, licence, notice, is_text) -> (doc_id, path, licence, score, how, licence_path).

    how: "own", "inherited" or null; licence_path: the file that states the licence.
    """
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "path", "body"))
    idf, known = weighed(rows, notices)
    # terms of templates: a bounded table, whose longest are tried first
    signs = sorted((r.term for r in known.where("sign").select("term").distinct().collect()), key=lambda t: (-len(t), t))
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    sign = r"(?!)" if not signs else r"(?<![\p{L}\p{N}])(?:" + _either([t.replace("cc-by", "cc by") for t in signs] + [t for t in signs if "cc-by" in t]) + r")(?![\p{L}\p{N}])"
    told = rows.where("doc_id is not null").where(F.lower("body").rlike(sign)).select("rid", F.split(F.lower("body"), "\n").alias("all"), _terms(F.col("body")).alias("terms"))
    told = told.withColumn("hits", F.transform("all", lambda x: x.rlike(sign)))
    wide = lambda i, of: F.slice(of, F.greatest(i, F.lit(1)), F.when(i > 0, 4).otherwise(3))
    said = lambda i: F.array_join(F.slice(F.col("all"), F.greatest(i, F.lit(1)), F.when(i > 0, 3).otherwise(2)), " ")  # noqa: E731  a line and its neighbours
    unit = lambda x, i: F.struct(i.alias("nth"), _terms(x).alias("terms"), F.array_distinct(_terms(F.array_join(wide(i, "all"), " "))).alias("wide"), _negated(_terms(said(i))).alias("says_no"))
    head = F.array_distinct(_terms(F.array_join(F.slice("all", 1, HEAD), " ")))
    windows = F.filter(F.transform("all", lambda x, i: F.when(F.array_contains(wide(i, "hits"), True), unit(x, i))), lambda x: x.isNotNull())
    told = materialize(told.select("rid", "terms", head.alias("head"), windows.alias("lines")).dropDuplicates(["rid"]), "licence-files")
    lines = told.select("rid", F.explode("lines").alias("l")).select("rid", "l.*")
    # what stands is judged by the unit: a line, a window or a head of lines, a file
    about = lambda terms, says_no: (F.size(F.array_distinct(terms)).alias("n_terms"), F.array_contains(terms, "copyright").alias("beside"), says_no.alias("says_no"))
    facts = ["n_terms", "beside", "says_no"]
    meant = _stands(F.col("n_terms"), F.col("beside"), F.col("says_no"))

    by_line = _cosines(lines.select("rid", "nth", "terms", *about(F.col("terms"), _negated(F.col("terms")))), ["rid", "nth", *facts], idf, known).where(meant)
    units = lines.select("rid", "nth", F.col("wide").alias("of"), *about(F.col("wide"), F.col("says_no")))
    units = units.unionByName(told.select("rid", F.lit(-1).alias("nth"), F.col("head").alias("of"), *about(F.col("head"), _negated(F.col("head")))))
    around = units.select("rid", "nth", *facts, F.explode("of").alias("term")).join(known, "term")
    held = around.groupBy("rid", "nth", *facts, *OF_TEMPLATE).agg(F.round(F.sum(F.col("tw") * F.col("tw")) / (F.col("tnorm") * F.col("tnorm")), 9).alias("score"))
    held = held.where((F.col("score") >= LEAST_HELD) & meant)
    # the text of a licence may say "not" more often than its template
    whole = _cosines(told.select("rid", "terms", *about(F.col("terms"), _negated(F.col("terms")))), ["rid", *facts], idf, known).where(meant | F.col("is_text"))
    by_kind = [df.select("rid", "licence", "score", F.round("tnorm", 6).alias("weight"), F.lit(kind).alias("kind"), is_file.alias("is_file")) for kind, df, is_file in ((0, whole, F.col("is_text") | (F.col("score") >= NOTHING_ELSE)), (1, by_line, F.lit(False)), (2, held, F.lit(False)))]
    named = by_kind[0].unionByName(by_kind[1]).unionByName(by_kind[2])
    own = named.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("minus"), (-F.col("weight")).alias("lighter"), "kind", "licence")).alias("b"), F.max("is_file").alias("is_file"))
    own = materialize(own.select("rid", F.col("b.licence").alias("own"), (-F.col("b.minus")).alias("own_score"), "is_file"), "licences")

    given = rows.select("rid", "doc_id", "path").join(own.hint("merge"), "rid", "left")
    parts = F.split("path", "/")
    of_dir = given.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("is_file") | F.col("path").rlike(FILE_NAME)))
    above = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    of_dir = of_dir.groupBy(above(F.size(parts) - 1).alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("minus"), "path", "own")).alias("given"))
    bare = F.col("own").isNull() & F.col("doc_id").isNotNull() & F.col("path").isNotNull()
    # each directory once, whatever files it holds: its ancestors, and the nearest that speaks
    dirs = given.where(bare).select(above(F.size(parts) - 1).alias("home"), F.slice(parts, 1, F.size(parts) - 1).alias("parts")).distinct()
    steps = dirs.select("home", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts").select("home", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("dir"))
    nearest = materialize(steps.join(of_dir, "dir").groupBy("home").agg(F.max(F.struct("depth", "given")).getField("given").alias("given")), "licence-folders")
    few = nearest.count() <= BROADCAST_ROWS
    out = given.withColumn("home", F.when(bare, above(F.size(parts) - 1))).join(F.broadcast(nearest) if few else nearest, "home", "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own", "given.own").alias("licence"),
        F.coalesce(F.col("own_score"), -F.col("given.minus")).alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").alias("how"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("given.path")).alias("licence_path"),
    )


def _either(words: list[str]) -> str:
    """A pattern of any of the words, by their first letters: at most one branch of a letter is tried."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w[1:])
    quoted = lambda x: "".join("\\" + c if not c.isalnum() and c != " " else c for c in x)
    return "|".join(f"{quoted(k)}(?:{'|'.join(sorted(set(map(quoted, v)), key=lambda x: (-len(x), x)))})" for k, v in sorted(by_letter.items()))
