"""Licence scan: TF-IDF cosine of headers and licence files to templates, inherited along paths.

Only built-in expressions; no Python runs on the executors.
"""

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, constant_array, constant_table, small_side

THRESHOLD = 0.75

# Notices by which works state their licence, as published.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ],
    "MPL-2.0": ["This work is subject to the terms of the Mozilla Public License, version 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_DISCLAIMER_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CLAUSES_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_THIRD_CLAUSE_BSD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_NOTICE_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. "
)
_DISCLAIMER_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def _gnu_notice(work: str, licence: str, version: str, sign: str) -> str:
    """The notice that the GNU licences ask for at the start of each file."""
    return (
        f"This {work} is free software{':' if version[0] == '3' else ';'} you can redistribute it and/or modify it under the "
        f"terms of the GNU {licence} as published by the Free Software Foundation{sign} either version {version} of the License, "
        f"or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        f"{licence} for more details."
    )


def _gnu_title(licence: str, version: str, date: str, years: str, place: str) -> str:
    """How the text of a GNU licence begins."""
    return (
        f"GNU {licence} Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. {place} Everyone is "
        "permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    )


_STREET = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_GPL, _LGPL = "General Public License", "Lesser General Public License"
# Licence texts and the notices that they ask for, as published. Of long texts the title and the opening.
PUBLISHED = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
        'DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as '
        "defined by Sections 1 through 9 of this document."
    ],
    "BSD-2-Clause": [_CLAUSES_BSD + _DISCLAIMER_BSD],
    "BSD-3-Clause": [_CLAUSES_BSD + _THIRD_CLAUSE_BSD + _DISCLAIMER_BSD],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [_gnu_notice("program", _GPL, "2", ";"), _gnu_title(_GPL, "2", "June 1991", "1989, 1991", _STREET)],
    "GPL-3.0": [_gnu_notice("program", _GPL, "3", ","), _gnu_title(_GPL, "3", "29 June 2007", "2007", "<https://fsf.org/>")],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "LGPL-2.1": [_gnu_notice("library", _LGPL, "2.1", ";"), _gnu_title(_LGPL, "2.1", "February 1999", "1991, 1999", _STREET)],
    "LGPL-3.0": [_gnu_notice("library", _LGPL, "3", ","), _gnu_title(_LGPL, "3", "29 June 2007", "2007", "<https://fsf.org/>")],
    "MIT": ["MIT License Copyright (c) " + _NOTICE_MIT + _DISCLAIMER_MIT],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, '
        "contributes to the creation of, or owns Covered Software.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ],
}
# Identifiers of the SPDX list besides the names themselves.
SPDX = {f"{n}{end}": n for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for end in ("-only", "-or-later")}
for _name in sorted(TEMPLATES.keys() | PUBLISHED.keys()):
    _ids = [_name, *[i for i, n in SPDX.items() if n == _name]]
    TEMPLATES[_name] = TEMPLATES.get(_name, []) + PUBLISHED.get(_name, []) + [f"SPDX-License-Identifier: {i}" for i in _ids]
LICENCE_NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
# Words of most English texts; a marker is one of these only where the others do not suffice.
ORDINARY = frozenset(
    "a all and any as at be by for free in is it may not of on or that the this to with you "
    "an are but can do either even from however its must no one only other out so such use used was will your following name more data".split()
)
_WORD = r"[^a-z0-9]+"


def template_vectors(templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[tuple], dict[str, float], float, list[str]]:
    """``(licence, template, word, weight / norm)`` rows, the words' idf, that of all other words, and the markers.

    A text without any marker word of a template is below the threshold: the weights of
    the template's other words together are too small. Any words will do that leave so little; long ones
    are taken first and ordinary ones last, as those occur in most texts of any kind.
    """
    texts = [(name, i, Counter(w for w in re.split(_WORD, t.lower()) if w)) for name, ts in sorted(templates.items()) for i, t in enumerate(ts)]
    seen = Counter(w for _, _, words in texts for w in words)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in seen.items()}
    rows, markers = [], set()
    for name, i, words in texts:
        weights = {w: n * idf[w] for w, n in words.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        rows += [(name, i, w, x / norm) for w, x in sorted(weights.items())]
        markers.update(_markers({w: x / norm for w, x in weights.items()}, idf))
    return rows, idf, math.log(1 + len(texts)) + 1, sorted(markers)


def _markers(weights: dict[str, float], idf: dict[str, float]) -> list[str]:
    """The marker words of one template, whose words have these parts of its norm."""
    markers, rest = [], 1.0
    for w in sorted(weights, key=lambda w: (w in ORDINARY, -len(w), -idf[w], w)):
        if rest < THRESHOLD * THRESHOLD - 1e-9:
            break
        markers.append(w)
        rest -= weights[w] ** 2
    return markers


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")


def _by_template(templates: dict[str, list[str]]) -> dict[tuple[str, int], tuple[int, dict[str, float]]]:
    """Per template its number of words and the words' weights, in the order that numbers templates."""
    weights: dict[tuple[str, int], dict[str, float]] = {}
    for name, i, word, t in template_vectors(templates)[0]:
        weights.setdefault((name, i), {})[word] = t
    return {k: (sum(1 for w in re.split(_WORD, templates[k[0]][k[1]].lower()) if w), ts) for k, ts in weights.items()}


def _possible(words: str, templates: dict[str, list[str]]) -> Column:
    """The templates, as ``t, len``, that the words of a text may reach the threshold for, in whatever unit.

    By the inequality of Cauchy and Schwarz no line, run or whole text has a cosine above the root of the summed squared
    weights of the template's words that the text has at all. Only texts with a marker of the template are looked at so.
    """
    _, idf, _, _ = template_vectors(templates)
    by_template = _by_template(templates)
    every = constant_array(sorted({w for _, ts in by_template.values() for w in ts}))
    least = THRESHOLD * THRESHOLD - 1e-6

    def option(present: Column, number: int, length: int, ts: dict[str, float]) -> Column:
        own, squares = constant_array(list(ts)), constant_array([x * x for x in ts.values()])
        reach = F.aggregate(F.array_intersect(present, own), F.lit(0.0), lambda total, w: total + F.get(squares, (F.array_position(own, w) - 1).cast("int")))
        marked = F.arrays_overlap(present, constant_array(_markers(ts, idf)))
        return F.when(marked & (reach >= least), F.struct(F.lit(number).alias("t"), F.lit(length).alias("len")))

    def options(present: Column) -> Column:
        all_ = [option(present, n, length, ts) for n, (length, ts) in enumerate(by_template.values())]
        return F.filter(F.array(*all_), lambda x: x.isNotNull())

    # The one-element transform finds the templates' words among the text's once.
    return F.get(F.transform(F.array(F.array_intersect(words, every)), options), F.lit(0))


def _concentrated(words: Column, templates: dict[str, list[str]]) -> Column:
    """Whether enough of the weight of a unit lies on words of templates for any cosine to reach the threshold.

    A cosine is at most the root of the part that the template's words have of the unit's squared weights; of
    the words of no template, each occurrence adds at least the square of one such word's weight to the whole.
    """
    _, idf, other, _ = template_vectors(templates)
    names = sorted(idf)
    every, squares = constant_array(names), constant_array([idf[w] ** 2 for w in names])
    least = THRESHOLD * THRESHOLD - 1e-6

    def share(ws: Column) -> Column:
        def add(total: Column, word: Column) -> Column:
            times = F.size(ws) - F.size(F.array_remove(ws, word))
            square = F.get(squares, (F.array_position(every, word) - 1).cast("int"))
            return F.struct((total["c"] + times * times * square).alias("c"), (total["n"] + times).alias("n"))

        def enough(total: Column) -> Column:
            return total["c"] >= least * (total["c"] + other * other * (F.size(ws) - total["n"]))

        total = F.aggregate(F.array_intersect(ws, every), F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n")), add)
        return F.get(F.transform(F.array(total), enough), F.lit(0))

    # The one-element transforms evaluate the words, and their sums, once.
    return F.get(F.transform(F.array(words), share), F.lit(0))


def _windows(texts: DataFrame, templates: dict[str, list[str]], scratch: Scratch) -> DataFrame:
    """``h, windows`` of texts ``h, words, ts``: runs of as many words as a template of ``ts`` that may reach the threshold for it.

    Lines do not matter, so a notice may be wrapped, quoted or inside a sentence. A run starts at any word of the
    template. Its cosine is at most its dot product over the root of its words' summed squares, as
    a word of n occurrences counts n * n times; runs below the threshold even so are left out.
    """
    spark = texts.sparkSession
    _, idf, other, _ = template_vectors(templates)
    by_template = _by_template(templates)
    longest = max(length for length, _ in by_template.values())
    # Rows that repeat a path and its text are windowed one by one.
    some = texts.select(F.monotonically_increasing_id().alias("row"), "h", F.size("words").alias("n"), "ts", "words")
    placed = some.select("row", "h", "n", "ts", F.posexplode("words").alias("pos", "word"))
    known = constant_table(spark, ["word", "idf"], sorted(idf.items()))
    each = placed.join(known, "word").select("row", "h", "n", "pos", "word", "idf", F.explode("ts").alias("t"))
    each = each.select("row", "h", "n", "pos", "word", "idf", "t.t", "t.len")
    table = constant_table(spark, ["t", "word", "weight"], [(n, w, x) for n, (_, ts) in enumerate(by_template.values()) for w, x in sorted(ts.items())])
    # Words of no template all weigh alike, so only the others are rows; these count for what they weigh less.
    rows = each.join(table, ["t", "word"], "left").select(
        "row", "h", "n", "pos", "t", "len", "weight",
        (F.col("idf") * F.coalesce("weight", F.lit(0.0))).alias("dot"),
        (F.col("idf") * F.col("idf") - F.lit(other * other)).alias("less"),
        (F.col("pos") / F.col("len")).alias("q"),
    )
    # A template's length is 1 in q.
    over = f"over (partition by row, t order by q range between current row and {1 - 0.5 / longest!r}D following)"
    summed = rows.select(
        "h", "pos", "len", "weight",
        F.expr(f"sum(dot) {over}").alias("dot"),
        (F.expr(f"sum(less) {over}") + F.least("len", F.col("n") - F.col("pos")) * F.lit(other * other)).alias("squares"),
    )
    likely = summed.filter("weight is not null").filter(F.col("dot") >= (THRESHOLD - 1e-6) * F.sqrt("squares"))
    windows = likely.groupBy("h").agg(F.collect_set(F.struct("pos", "len")).alias("windows"))
    return scratch.table(windows, "windows")


def matches(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``path, licence, score, whole`` of each file's best template, for files that reach the threshold.

    Compared are every line, every run of as many words as a template and the whole text, as bags of words
    weighted by TF-IDF. ``whole`` says that the whole text matches, as that of a licence file does. Ties go to the first name.
    """
    vectors, idf, other, markers = template_vectors(templates)
    marked = F.arrays_overlap("words", constant_array(markers))
    texts = files.filter("text is not null").select("path", "text", _words(F.col("text")).alias("words")).filter(marked)
    scratch = Scratch(files.sparkSession, "notices")
    texts = texts.withColumn("ts", _possible("words", templates)).filter(F.size("ts") > 0)
    texts = scratch.table(texts, "likely")
    lines = F.transform(F.split("text", r"\r?\n"), lambda l: F.struct(l.alias("unit"), F.lit(False).alias("whole")))
    whole = F.array(F.struct(F.col("text").alias("unit"), F.lit(True).alias("whole")))
    units = texts.select("path", F.explode(F.concat(lines, whole)).alias("u"))
    units = units.select("path", "u.whole", _words(F.col("u.unit")).alias("words")).filter(marked)
    # Most lines and long texts cannot match: they are left out before any of their words is a row.
    units = units.filter(_concentrated(F.col("words"), templates) & (F.size(_possible("words", templates)) > 0))
    hashed = texts.select("path", F.xxhash64("path", "text").alias("h"), "words", "ts")
    runs = hashed.join(small_side(_windows(hashed, templates, scratch)), "h")
    runs = runs.select("path", "words", F.explode("windows").alias("r"))
    runs = runs.select("path", F.lit(False).alias("whole"), F.slice("words", F.col("r.pos") + 1, F.col("r.len")).alias("words"))
    units = units.unionByName(runs).distinct()
    terms = (
        units.withColumn("unit", F.xxhash64("words"))
        .select("path", "whole", "unit", F.explode("words").alias("word"))
        .groupBy("path", "whole", "unit", "word")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    weighted = terms.join(constant_table(files.sparkSession, ["word", "idf"], sorted(idf.items())), "word", "left")
    weighted = weighted.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    unit = ["path", "whole", "unit"]
    norms = weighted.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    table = constant_table(files.sparkSession, ["licence", "template", "word", "t"], vectors)
    dots = weighted.join(table, "word").groupBy(*unit, "licence", "template").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dots.join(norms, unit).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= THRESHOLD)
    best = scored.groupBy("path").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"), F.max(F.col("whole")).alias("whole")
    )
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), "whole")


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``path, licence, found, score, licence_path`` of every row of ``path, text``.

    ``found`` is ``own`` for a file that matches a template itself, ``inherited`` for one whose nearest
    ancestor directory holds a licence file, and ``none``. A licence file is one whose whole text matches,
    or one with a licence file's name and a matching line; of several in a directory the best match counts, then
    the first path. Directories, not files, are joined to their ancestors, so a directory may hold
    any number of files. Rows without a path match by themselves but inherit nothing; NULL and empty texts match nothing;
    rows that repeat a path share the best of their matches.
    """
    scratch = Scratch(files.sparkSession, "licences")
    key = F.coalesce(F.col("path"), F.concat(F.lit("\x00"), F.sha1(F.coalesce("text", F.lit("")))))
    named = files.select(key.alias("path"), "text")
    own = scratch.table(matches(named, templates), "own")
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    licence_files = own.filter((F.col("whole") | F.col("path").rlike(LICENCE_NAMES)) & ~F.col("path").startswith("\x00"))
    governed = (
        licence_files.withColumn("dir", parent)
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("g"))
        .select(F.col("dir").alias("up"), F.col("g.licence").alias("from_dir"), F.col("g.path").alias("licence_path"))
    )
    directories = files.filter("path is not null").select(parent.alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = directories.select(
        "dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth")
    ).withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(governed, "up").groupBy("dir").agg(
        F.max_by(F.struct("from_dir", "licence_path"), "depth").alias("n")
    )
    nearest = scratch.table(nearest.select("dir", "n.from_dir", "n.licence_path"), "nearest")
    rows = named.select("path").join(small_side(own.drop("whole")), "path", "left").withColumn("dir", parent)
    rows = rows.join(small_side(nearest), "dir", "left")
    inherits = F.col("licence").isNull() & F.col("from_dir").isNotNull() & ~F.col("path").startswith("\x00")
    return rows.select(
        F.when(~F.col("path").startswith("\x00"), F.col("path")).alias("path"),
        F.when(inherits, F.col("from_dir")).otherwise(F.col("licence")).alias("licence"),
        F.when(F.col("licence").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("found"),
        F.col("score"),
        F.when(inherits, F.col("licence_path")).alias("licence_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files ``path, text`` under source and language; a NULL part is named ``-``."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("source", "lang")]
    path = F.concat_ws("/", *part, F.col("doc_id").cast("string"))
    return docs.select(F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
