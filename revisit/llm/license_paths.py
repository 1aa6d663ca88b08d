"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates,
then inheritance from the nearest ancestor directory.

Each licence has several templates: its text or standard header, its title, its
usual one-line notices and its SPDX line.  The passages of a file are compared
with all of them: a licence file as a whole, the comment block at the head of a
file, each paragraph (lines up to a blank one, so that wrapped notices are whole)
and each line.  Weights are term frequency times the inverse document frequency
of the whole corpus, counted in Spark for the words of the templates; a word of
no template weighs as one that a single document holds.  A file without a match
takes the licence of the licence files in its nearest ancestor directory.

Null and empty texts match nothing and may inherit; null paths inherit nothing.
Of equal cosines the first licence name wins.  Repeated rows get equal results;
an empty table gives no rows.  Extra columns are kept out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from revisit.llm.common import staged
from revisit.llm.linking import bounded_broadcast

# Texts, standard headers and notices of public licences.
_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
          "derived from this software without specific prior written permission.")
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
            "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
            "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
            "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
            "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
            "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions:")
_MIT_END = ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            + _WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
            "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE.")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
        "Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU {} for more details.")
TEMPLATES = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": ["BSD 2-Clause License", f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met.", f"{_BSD} {_BSD_3} {_BSD_END}", f"{_BSD} {_BSD_3}"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU.format("General Public License", 2, "General Public License")],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                "This work is licensed under the GNU General Public License, version 3.",
                _GNU.format("General Public License", 3, "General Public License")],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                 _GNU.format("Lesser General Public License", 3, "Lesser General Public License")],
    "MIT": ["MIT License", "The MIT License (MIT)", "Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} {_MIT_END}"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# SPDX identifiers beside the names above.
SPDX = {"GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"],
        "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"]}
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENCE_FILE = re.compile(r"(?:^|/)(?:licen[sc]e|copying|notice)(?:[.-][a-z0-9.]+)?$", re.I)
# What a comment line of common languages begins with.
COMMENT = re.compile(r"\s*(?:#|//+|/\*+|\*+/?|--+|;+|%+|<!--|\"\"\"|'''|rem\b)\s?", re.I)


def with_spdx(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    return {k: [*v, *[f"SPDX-License-Identifier: {n}" for n in (k, *SPDX.get(k, []))]] for k, v in templates.items()}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def header(lines: list[str]) -> str:
    """The comment block at the head of a file, without its marks; empty if
    the file does not begin with one."""
    out, at = [], 0
    if lines and lines[0].startswith("#!"):
        at = 1
    for line in lines[at:]:
        m = COMMENT.match(line)
        if m:
            out.append(line[m.end():])
        elif line.strip() or not out:
            if line.strip():
                break
    return " ".join(out)


def passages(text: str, whole: bool) -> list[str]:
    lines = text.split("\n")
    paragraphs, run = [], []
    for line in [*lines, ""]:
        if line.strip():
            run.append(line)
        else:
            if len(run) > 1:
                paragraphs.append(" ".join(run))
            run = []
    head = header(lines)
    return [*([text] if whole else []), *([head] if head else []), *paragraphs, *lines]


class Matcher:
    """TF-IDF vectors of the templates; ``df`` of ``n`` documents."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n: int, least: float):
        weigh = lambda d: 1 + math.log((1 + n) / (1 + d))
        counts = [(k, Counter(words(t))) for k, v in sorted(templates.items()) for t in v]
        self.idf = {w: weigh(df.get(w, 0)) for _, c in counts for w in c}
        self.rest = weigh(1)
        self.vectors = [(k, self.unit(c)) for k, c in counts]
        # a passage with a cosine of ``least`` holds words that make up least^2 of the template's square
        # length, so it holds one of any words that make up more than the rest
        self.triggers = set()
        for _, v in self.vectors:
            share = 0.0
            for w, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
                self.triggers.add(w)
                share += x * x
                if share > 1 - least * least + 1e-9:
                    break

    def unit(self, counts: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.rest) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    def best(self, texts: list[str]) -> tuple[str | None, float]:
        """The best template over some passages: (licence, cosine)."""
        name, top = None, 0.0
        for p in texts:
            counts = Counter(words(p))
            if counts.keys().isdisjoint(self.triggers):
                continue
            v = self.unit(counts)
            for k, t in self.vectors:
                c = sum(x * v[w] for w, x in t.items() if w in v)
                if c > top + 1e-12:
                    name, top = k, c
        return name, top

    def of(self, text: str | None, path: str | None) -> tuple[str | None, float]:
        low = (text or "").lower()
        if not any(w in low for w in self.triggers):
            return None, 0.0
        return self.best(passages(text, bool(path and LICENCE_FILE.search(path))))


def document_frequencies(files: DataFrame, text_col: str, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each word of the vocabulary, and all documents; at
    most one row a word comes to the driver."""
    @F.pandas_udf("array<string>")
    def held(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(vocabulary.intersection(words(t))) if t else [])
    rows = files.select(F.explode(held(F.col(text_col))).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}, files.count()


def scan_licenses(files: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, list[str]] = TEMPLATES, min_cosine: float = 0.8) -> DataFrame:
    """(id, path, license, cosine, origin) for every file; origin is own,
    inherited or none.  ``cosine`` is the best one of the passages that can reach
    ``min_cosine``.  Only the templates, an argument, and their document
    frequencies travel to the tasks."""
    templates = with_spdx(templates)
    df, n = document_frequencies(files, text_col, {w for v in templates.values() for t in v for w in words(t)})
    matcher = Matcher(templates, df, n, min_cosine)

    @F.pandas_udf("license string, cosine double")
    def match(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p in zip(texts, paths):
            name, c = matcher.of(t, p)
            rows.append((name if c >= min_cosine else None, round(c, 6)))
        return pd.DataFrame(rows, columns=["license", "cosine"])

    rows = staged(files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), match(F.col(text_col), F.col(path_col)).alias("m"))
                  .select("id", "path", F.col("m.license").alias("own"), F.col("m.cosine").alias("cosine")), "licences")
    directory = F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), r"/$", "")
    given = staged(rows.where(F.col("path").rlike("(?i)" + LICENCE_FILE.pattern) & F.col("own").isNotNull())
                   .groupBy(directory.alias("dir")).agg(F.min("own").alias("given")), "given")
    # path join: each directory asks all its ancestors, and the longest that answers wins
    up = F.split(directory, "/")
    asks = (rows.where("path is not null").select(directory.alias("at"), up.alias("up")).distinct()
            .select("at", F.explode(F.transform(F.sequence(F.lit(0), F.size("up")), lambda n: F.array_join(F.slice("up", 1, n), "/")))
                    .alias("dir")).distinct())
    near = asks.join(bounded_broadcast(given), "dir").groupBy("at").agg(F.max_by("given", F.length("dir")).alias("inherited"))
    return (rows.withColumn("at", directory).join(near, "at", "left")
            .select("id", "path", F.coalesce("own", "inherited").alias("license"), "cosine",
                    F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
                    .otherwise("none").alias("origin")))
