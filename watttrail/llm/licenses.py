"""Licence scan: TF-IDF cosine of statements and whole files to templates, then inheritance.

Units are the windows of up to ``WINDOW`` consecutive lines that have terms (headers, notices and
titles that may be wrapped) and the file as a whole (licence files). The weight of a term is its
count times ``ln((1 + N) / (1 + df)) + 1`` with ``df`` the number of files that hold it; terms of
no template count as held by none. A file's own licence is the template with the highest cosine
over its units, if that reaches ``LEAST``; ``own_licenses`` names all that reach it.

Only units that could reach ``LEAST`` are scored: a cosine is at most the norm of a template's
terms that the unit holds, so a unit must hold a term outside the commonest terms of the template
that together stay below ``LEAST`` (its anchors). That is exact.

A file without a licence of its own takes that of the nearest directory above it that has a
licence file. Directories are joined with their ancestors, once for each distinct directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watttrail.operators.skew import lookup
from watttrail.session import stage

LEAST = 0.8
#: Lines of the longest window.
WINDOW = 4
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Titles, statements, headers and whole texts of each licence; fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _BSD],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", _MIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
}
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
_TERMS = re.compile(_TERM)
_OWN = ("own_license", "own_score", "own_licenses")
_LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"


def terms(text: str) -> Counter:
    return Counter(_TERMS.findall(text.lower()))


def sum_of(parts: list[Counter]) -> Counter:
    whole: Counter = Counter()
    for part in parts:
        whole.update(part)
    return whole


class Matcher:
    """Weighted templates for a given document frequency of their terms."""

    def __init__(self, templates: dict[str, list[str]], held: dict[str, int], files: int, least: float = LEAST):
        self.unknown = math.log(1 + files) + 1
        self.idf = {t: math.log((1 + files) / (1 + n)) + 1 for t, n in held.items()}
        self.least = least
        self.vectors: list[tuple[str, dict[str, float]]] = []
        self.anchors: dict[str, list[int]] = {}
        for name, statements in sorted(templates.items()):
            for statement in statements:
                weights = {t: n * self._idf(t) for t, n in terms(statement).items()}
                norm = math.sqrt(sum(w * w for w in weights.values()))
                vector = {t: w / norm for t, w in weights.items()}
                below = 0.0
                for t, w in sorted(vector.items(), key=lambda x: (self._idf(x[0]), x[1], x[0])):
                    below += w * w
                    if math.sqrt(below) >= least - 1e-9:
                        self.anchors.setdefault(t, []).append(len(self.vectors))
                self.vectors.append((name, vector))

    def _idf(self, term: str) -> float:
        return self.idf.get(term, self.unknown)

    def scores(self, counts: Counter) -> list[tuple[float, str]]:
        """Cosine and licence of each template that a unit with these terms could match."""
        near = {k for t in counts for k in self.anchors.get(t, ())}
        if not near:
            return []
        weights = {t: n * self._idf(t) for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        pairs = (self.vectors[k] for k in near)
        return [(sum(w * weights.get(t, 0.0) for t, w in v.items()) / norm, name) for name, v in pairs]

    def best(self, unit: str) -> tuple[float, str]:
        """Highest cosine and its licence; ties to the name first in order. ``(0, "")`` if none could match."""
        return self._top(self.scores(terms(unit)))

    @staticmethod
    def _top(found: list[tuple[float, str]]) -> tuple[float, str]:
        return min(found, key=lambda x: (-x[0], x[1]), default=(0.0, ""))

    def scan(self, text: str) -> tuple[str | None, float | None, list[str]]:
        lines = [c for c in map(terms, text.split("\n")) if c]
        marked = [not self.anchors.keys().isdisjoint(c) for c in lines]
        found = self.scores(sum_of(lines))
        for k in range(len(lines)):
            window: Counter = Counter()
            hit = False
            for c, mark in zip(lines[k : k + WINDOW], marked[k : k + WINDOW], strict=True):
                window.update(c)
                hit |= mark
                if hit:
                    found += [x for x in self.scores(window) if x[0] >= self.least]
        found = [x for x in found if x[0] >= self.least]
        if not found:
            return None, None, []
        score, name = self._top(found)
        return name, score, sorted({n for _, n in found})


def match_files(df: DataFrame, text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The columns of ``df`` without the text, with ``own_license``, ``own_score`` (null if none) and ``own_licenses``."""
    vocabulary = sorted({t for s in templates.values() for x in s for t in terms(x)})
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(_TERM), F.lit(0)))
    held = df.select(F.explode(F.array_intersect(found, F.array(*map(F.lit, vocabulary)))).alias("term"))
    counts = {r.term: r.n for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}  # terms of templates only
    matcher = Matcher(templates, {t: counts.get(t, 0) for t in vocabulary}, df.count(), least)
    kept = [c for c in df.columns if c != text_col and c.lower() not in _OWN]
    rows = df.select(*kept, text_col)
    anchor = re.compile("|".join(map(re.escape, sorted(matcher.anchors, key=lambda t: (-len(t), t)))))
    own = T.StructType.fromDDL("own_license string, own_score double, own_licenses array<string>")
    schema = T.StructType([*df.select(*kept).schema.fields, *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            got = [matcher.scan(t) if anchor.search(t.lower()) else (None, None, []) for t in texts]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()))
            arrays = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], [*kept, *_OWN])

    return rows.mapInArrow(run, schema)


def _directory(path: Column) -> Column:
    """Directory of a path without a final slash; empty for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, the root last."""
    parts = F.split(directory, "/")
    ups = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    return F.array_distinct(F.concat(ups, F.array(F.lit(""))))


def scan_licenses(
    df: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST
) -> DataFrame:
    """The columns of ``df`` without the text, ``own_license``, ``own_score``, ``own_licenses``, ``license`` and ``inherited_from``.

    ``inherited_from`` is the directory (empty: the root) whose licence file gave the licence;
    null where the licence is the file's own or there is none. Of several licence files in a
    directory the highest score counts, then the smallest path. A null text is empty; a file with
    a null path inherits nothing and lends nothing. Repeated rows are all kept; an empty table
    gives an empty result. Columns of ``df`` with the names of results are replaced; all others
    stay, whatever their names.
    """
    names = {f"c{i}": c for i, c in enumerate(df.columns)}
    place = {c: at for at, c in names.items()}
    path, text = F.col(place[path_col]), place[text_col]
    kept = [at for at, c in names.items() if c != text_col and c.lower() not in (*_OWN, "license", "inherited_from")]
    files = df.toDF(*names).select(*kept, text)
    scored = stage(match_files(files, text, templates, least).withColumn("dir", _directory(path)), "licenses")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    lenders = scored.where(F.col("own_license").isNotNull() & name.rlike(_LICENCE_FILE))
    order = F.struct((-F.col("own_score")).alias("s"), path.alias("p"), F.col("own_license").alias("l"))
    lent = lenders.groupBy(F.col("dir").alias("above")).agg(F.min(order)["l"].alias("lent"))
    directories = stage(scored.where("dir is not null").groupBy("dir").agg(F.count("*").alias("n")), "directories")
    # one row for each distinct directory and level above it; the root and top folders are hot keys
    ups = stage(directories.select("dir", F.posexplode(_ancestors(F.col("dir"))).alias("up", "above")), "ups")
    sizes = ups.groupBy("above").agg(F.count("*").alias("n"))
    lending = stage(lent.join(sizes, "above").select("above", "n", F.struct("lent").alias("by")), "lending")
    served = lookup(ups, lending, "above", "n", ups.count(), "dir").where("by is not null")
    nearest = served.groupBy("dir").agg(F.min(F.struct("up", "above", F.col("by.lent").alias("lent"))).alias("near"))
    entries = directories.join(nearest, "dir", "left").select("dir", "n", "near.above", "near.lent")
    total = directories.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = lookup(scored, stage(entries, "inherited"), "dir", "n", total, place[path_col])
    own = F.col("own_license")
    results = [*_OWN, F.coalesce(own, "lent").alias("license"), F.when(own.isNull(), F.col("above")).alias("inherited_from")]
    return joined.select(*[F.col(at).alias(names[at]) for at in kept], *results)
