"""License scan in DataFrame operations only: TF-IDF cosine to templates, then inheritance from directories.

Units of a file are its lines, its paragraphs (runs of two or more lines that have a word, so that a header wrapped over
lines, with or without comment marks, is one unit) and the file as a whole. A unit is a bag of words (runs of a-z and 0-9 in lower case)
weighed by tf * idf, with document frequencies over all files. The template with the largest cosine of at least
THRESHOLD is the license of a unit; the best unit is that of the file. Templates are headers, opening sentences, titles
and whole texts of licenses. A file that as a whole reaches THRESHOLD, or that begins with a title, is a licence file:
files below its directory that state no license of their own inherit from the nearest such directory, found by joining
ancestor paths.

Only files with one of a template's telling words can reach THRESHOLD: those are its heaviest words that together
carry more than 1 - THRESHOLD**2 of its squared weight. All other files leave before their units are made. Of the units,
those leave whose words outside the templates alone make the cosine too small, counting them as lightly as a word can weigh,
first against all words of templates together and then against each template; the words of the few that are left are
then counted over all files, by a join.

Ties go to the earlier first line, then to the earlier last line, then to the earlier template; of several licence files of
a directory the smallest path counts, with its best unit. Null and empty texts state nothing, but inherit. Null paths
neither give nor inherit. Rows that repeat a path are one file that states what any of them does. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.llm.common import materialize, missing

THRESHOLD = 0.8
#: Headers and opening sentences of well-known licenses (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)
#: Whole texts of short licenses and notices, and the titles that licence files begin with (fixed values).
WHOLE_TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
later version."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
)
TITLES = (
    ("MIT", "The MIT License"), ("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)
TEMPLATES = TEMPLATES + WHOLE_TEXTS + TITLES
FIRST_TITLE = len(TEMPLATES) - len(TITLES)
#: Words that are looked up by broadcast, at most.
FEW = 100_000
_APART = "[^a-z0-9]+"
WHOLE = -1  # the line number of the file as a whole


def _words(text: Column) -> Column:
    return F.split(F.lower(text), _APART)


def _has_one(text: Column, words: list[str]) -> Column:
    """Is one of the words in the text? The text is named once, so that it is cut once."""
    return F.arrays_overlap(_words(text), F.array(*[F.lit(w) for w in words]))


def _vocabulary() -> dict[str, dict[int, int]]:
    """Word to (template number to occurrences)."""
    found: dict[str, dict[int, int]] = {}
    for k, (_, text) in enumerate(TEMPLATES):
        for word in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split():
            found.setdefault(word, {}).setdefault(k, 0)
            found[word][k] += 1
    return found


def inverse_frequencies(files: DataFrame, text: str) -> tuple[dict[str, float], int]:
    """(idf of each word of the templates, number of files), over all files with a text."""
    some = files.where(F.col(f"`{text}`").isNotNull())
    total = some.count()
    words = sorted(_vocabulary())
    seen = some.select(F.explode(F.array_distinct(_words(F.col(f"`{text}`")))).alias("w")).where(F.col("w").isin(words))
    df = {r[0]: r[1] for r in seen.groupBy("w").count().collect()}
    idf = lambda n: math.log((1 + total) / (1 + n)) + 1
    return {w: idf(df.get(w, 0)) for w in words}, total


def _weights(idf: dict[str, float]) -> list[tuple[str, int, float]]:
    """(word, template, weight), templates of length one."""
    raw = [(w, k, n * idf[w]) for w, own in _vocabulary().items() for k, n in own.items()]
    norm = {k: math.sqrt(sum(x * x for _, j, x in raw if j == k)) for k in range(len(TEMPLATES))}
    return sorted((w, k, x / norm[k]) for w, k, x in raw)


def _telling(weights: list[tuple[str, int, float]], threshold: float) -> list[str]:
    """Words of which a text must have one to reach the threshold with any template."""
    out = set()
    for k in range(len(TEMPLATES)):
        share = 0.0
        for x, w in sorted(((x, w) for w, j, x in weights if j == k), reverse=True):
            out.add(w)
            share += x * x
            if share > 1 - threshold * threshold + 1e-9:
                break
    return sorted(out)


def _units(chosen: DataFrame, telling: list[str]) -> DataFrame:
    """Rows (path, h, line, last, first, unit): lines and paragraphs that may tell, and whole files."""
    file = Window.partitionBy("path", "h")
    split = chosen.select("path", "h", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    worded = split.where(F.lower("unit").rlike("[a-z0-9]")).select(
        "*", (F.col("line") - F.row_number().over(file.orderBy("line"))).alias("run"), (F.min("line").over(file) == F.col("line")).alias("first")
    )
    single = worded.select("path", "h", "line", F.col("line").alias("last"), "first", "unit")
    paragraphs = worded.groupBy("path", "h", "run").agg(
        F.min("line").alias("line"), F.max("line").alias("last"), F.bool_or("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "unit"))), lambda x: x["unit"]), "\n").alias("unit"),
    ).where("last > line").drop("run")
    parts = single.unionByName(paragraphs).where(_has_one(F.col("unit"), telling))
    whole = F.lit(WHOLE)
    return parts.unionByName(chosen.select("path", "h", whole.alias("line"), whole.alias("last"), F.lit(False).alias("first"), F.col("text").alias("unit")))


def _near(bags: DataFrame, template: DataFrame, unit: list[str], threshold: float) -> DataFrame:
    """The units whose largest cosine to one template reaches the threshold if all words outside the templates weigh 1.

    No word weighs less, so no other unit reaches it with any counts.
    """
    inner = bags.select(*unit, (F.col("inside") + F.col("outside")).alias("squares"), F.inline("bag")).where("idf is not null")
    dots = inner.join(F.broadcast(template), "w").groupBy(*unit, "template").agg(
        F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"), F.first("squares").alias("squares")
    )
    reached = dots.where(F.col("dot") * F.col("dot") >= F.lit(threshold * threshold - 1e-4) * F.col("squares"))
    return bags.join(reached.select(*unit).distinct(), unit, "left_semi")


def stated(files: DataFrame, threshold: float = THRESHOLD, path: str = "path", text: str = "text", few: int = FEW) -> DataFrame:
    """(path, h, line, last, first, template, score) of every unit that reaches the threshold, with its best template.

    ``h`` tells rows with one path apart, ``line`` and ``last`` are the first and the last line (WHOLE: the file).
    """
    spark = files.sparkSession
    idf, total = inverse_frequencies(files, text)
    weights = _weights(idf)
    telling = _telling(weights, threshold)
    named = files.where(F.col(f"`{path}`").isNotNull()).select(F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
    named = named.where(_has_one(F.col("text"), telling)).select("path", F.xxhash64("text").alias("h"), "text")
    chosen = materialize(named.distinct())  # few files, read twice below
    unit = ["path", "h", "line", "last", "first"]
    words = _units(chosen, telling).select(*unit, F.explode(_words(F.col("unit"))).alias("w")).where("w <> ''")
    counted = words.groupBy(*unit, "w").agg(F.count(F.lit(1)).alias("tf"))
    # A few hundred rows, whatever the data.
    known = spark.createDataFrame(sorted(idf.items()), "w string, idf double")
    template = spark.createDataFrame(weights, "w string, template int, weight double")
    bags = counted.join(F.broadcast(known), "w", "left").groupBy(*unit).agg(
        F.collect_list(F.struct("w", "tf", "idf")).alias("bag"),
        F.sum(F.col("tf") * F.col("tf") * F.col("idf") * F.col("idf")).alias("inside"),
        F.coalesce(F.sum(F.when(F.col("idf").isNull(), F.col("tf") * F.col("tf"))), F.lit(0)).alias("outside"),
    )
    # An idf is 1 at least: what is below the threshold then is below it with any counts.
    within = F.col("inside") >= F.lit(threshold * threshold - 1e-4) * (F.col("inside") + F.col("outside"))
    left = materialize(_near(materialize(bags.where(within)), template, unit, threshold).select(*unit, F.inline("bag")))
    asked = materialize(left.where("idf is null").select("w").distinct())
    every = files.where(F.col(f"`{text}`").isNotNull()).select(F.explode(F.array_distinct(_words(F.col(f"`{text}`")))).alias("w"))
    # Looked up by broadcast, the words of all files do not move; counted first, each task gives a word once at most.
    if asked.count() <= few:
        df = every.join(F.broadcast(asked), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    else:
        df = every.groupBy("w").agg(F.count(F.lit(1)).alias("df")).join(asked.hint("merge"), "w", "left_semi")
    other = df.select("w", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("other"))
    weighed = left.join(other, "w", "left").select(*unit, "w", (F.col("tf") * F.coalesce("idf", "other")).alias("x"))
    weighed = materialize(weighed)
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(template), "w").groupBy(*unit, "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, unit).select(*unit, "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = Window.partitionBy(*unit).orderBy(F.desc("score"), "template")
    return scored.where(F.col("score") >= threshold).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def _above(path: Column) -> Column:
    """Directories above a path, the nearest first; the root is ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, threshold: float = THRESHOLD, path: str = "path", text: str = "text", few: int = FEW) -> DataFrame:
    """Rows (path, license, score, line, origin, levels), one for each path.

    ``origin`` is the path of the file that states the license and ``levels`` how many directories up it was found
    (null: the file itself); all are null where there is none.
    """
    missing(files, path, text)
    found = materialize(stated(files, threshold, path, text, few))
    # One row for each path: a partial aggregate, so that no path gathers its lines.
    rank = F.struct((-F.col("score")).alias("s"), "line", "last", "template")
    own = found.groupBy("path").agg(F.min(rank).alias("b"))
    title = F.col("first") & (F.col("template") >= FIRST_TITLE)
    giving = found.where((F.col("line") == WHOLE) | title)
    folders = giving.select(
        F.get(_above(F.col("path")), F.lit(0)).alias("folder"), F.struct("path", (-F.col("score")).alias("s"), "template").alias("of")
    ).groupBy("folder").agg(F.min("of").alias("of"))
    paths = files.where(F.col(f"`{path}`").isNotNull()).select(F.col(f"`{path}`").alias("path")).distinct()
    stating = paths.join(own, "path", "left")
    silent = stating.where("b is null").select("path", F.posexplode(_above(F.col("path"))).alias("levels", "folder"))
    nearest = silent.join(folders, "folder").groupBy("path").agg(F.min(F.struct("levels", "of")).alias("n"))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    resolved = stating.join(nearest, "path", "left").select(
        "path",
        F.get(names, F.coalesce("b.template", "n.of.template")).alias("license"),
        (-F.coalesce("b.s", "n.of.s")).alias("score"),
        F.col("b.line").alias("line"),
        F.when(F.col("b").isNotNull(), F.col("path")).otherwise(F.col("n.of.path")).alias("origin"),
        F.col("n.levels").alias("levels"),
    )
    return resolved


def document_path() -> Column:
    """Documents as a tree of files: source, language, id."""
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    return F.concat_ws("/", part("source"), part("lang"), F.col("doc_id").cast("string"))


def documents(table: DataFrame) -> DataFrame:
    """doc_id, path, license ('none' if there is none), score, line, origin, levels of every document that has an id.

    Where nothing is stated or inherited score is 0, origin empty, and line and levels are -2.
    """
    files = table.where(F.col("doc_id").isNotNull()).select("doc_id", document_path().alias("path"), "text")
    ids = files.select("doc_id", "path").distinct()
    value = lambda c, other: F.coalesce(c, F.lit(other)).alias(c)
    return ids.join(scan(files), "path").select(
        "doc_id", "path", value("license", "none"), value("score", 0.0), value("line", -2), value("origin", ""), value("levels", -2)
    )


def _oracle() -> str:
    rows = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    return f"""
with templates(template, license, body) as (values {rows}),
files as (select doc_id, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), doc_id::varchar) as path, text from documents where doc_id is not null),
texts as (select row_number() over () as h, path, text from (select distinct path, text from files where text is not null)),
tw as (select template, w, count(*) as tf from (select template, unnest(regexp_split_to_array(lower(body), '{_APART}')) as w from templates) where w <> '' group by all),
n as (select count(*) as n from files where text is not null),
df as (select w, count(*) as df from (select unnest(list_distinct(regexp_split_to_array(lower(text), '{_APART}'))) as w from files where text is not null) group by w),
idf as (select w, ln((1 + n) / (1 + coalesce(df, 0))) + 1 as idf from (select w from df union select w from tw) v left join df using (w), n),
tx as (select template, w, tf * idf as x from tw join idf using (w)),
tn as (select template, sqrt(sum(x * x)) as norm from tx group by template),
ls as (select path, h, unnest(range(len(parts))) as line, unnest(parts) as unit from (select path, h, string_split(text, chr(10)) as parts from texts)),
worded as (select *, line - row_number() over (partition by path, h order by line) as run, min(line) over (partition by path, h) = line as first
  from ls where regexp_matches(lower(unit), '[a-z0-9]')),
units as (select path, h, line, line as last, first, unit from worded
  union all select path, h, min(line), max(line), bool_or(first), string_agg(unit, chr(10) order by line) from worded group by path, h, run having count(*) > 1
  union all select path, h, {WHOLE}, {WHOLE}, false, text from texts),
words as (select path, h, line, last, first, w, count(*) as tf
  from (select path, h, line, last, first, unnest(regexp_split_to_array(lower(unit), '{_APART}')) as w from units) where w <> '' group by all),
x as (select path, h, line, last, first, w, tf * idf as x from words join idf using (w)),
xn as (select path, h, line, last, sqrt(sum(x * x)) as norm from x group by all),
dots as (select path, h, line, last, first, template, sum(x.x * tx.x) as dot from x join tx using (w) group by all),
scored as (select path, h, line, last, first, template, round(dot / xn.norm / tn.norm, 6) as score from dots join xn using (path, h, line, last) join tn using (template)),
found as (select * from scored where score >= {THRESHOLD} qualify row_number() over (partition by path, h, line, last order by score desc, template) = 1),
own as (select * from found qualify row_number() over (partition by path order by score desc, line, last, template) = 1),
folders as (select regexp_replace(path, '/?[^/]*$', '') as folder, min(row(path, -score, template)) as f from found
  where line = {WHOLE} or (first and template >= {FIRST_TITLE}) group by 1),
up as (select path, unnest(range(len(string_split(path, '/')))) as levels, string_split(path, '/') as parts
  from (select distinct path from files) where path not in (select path from own)),
near as (select path, levels, f from (select path, levels, array_to_string(parts[1:len(parts) - 1 - levels], '/') as folder from up) join folders using (folder)
  qualify row_number() over (partition by path order by levels) = 1)
select doc_id, files.path as path, coalesce(t.license, 'none') as license, coalesce(own.score, -f[2], 0.0)::double as score,
  coalesce(own.line, -2)::integer as line,
  coalesce(own.path, f[1], '') as origin, coalesce(near.levels, -2)::integer as levels
from (select distinct doc_id, path from files) files left join own on files.path = own.path left join near on files.path = near.path
left join templates t on t.template = coalesce(own.template, f[3])
"""


ORACLE = _oracle()
