"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

A text is split into parts: every line, every paragraph (run of lines without a
blank one), and the whole.  A part is normalised to lower-case words without
punctuation, copyright lines left out, and compared with every template by
``2 * common / (bigrams of the part + bigrams of the template)``, bigrams counted
with repeats.  The coefficient cannot exceed twice the smaller size over the sum
of the sizes, so a part of ``n`` bigrams can only match templates between
``n * t / (2 - t)`` and ``n * (2 - t) / t`` bigrams; parts that no template can
reach are never cut into bigrams, and an index from bigrams to templates finds
the common ones of the rest.

A licence that no part reaches is sought in runs of words: the bigrams of the whole
text that a template has are its anchors, and every run that begins and ends in
an anchor and whose size the template allows is scored.  So a licence in several
paragraphs, in one block with code, or inside a long line is found.

Each template's best part is reported; ties go to the earlier part, longer
before shorter.  A text has the licence of its best template, ties by name.  A
null or empty text has none.  Rows that repeat are scanned alike.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, table

THRESHOLD = 0.8

# Wording of licences and of the notices that refer to them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version.",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
    "Proprietary": ("All rights reserved.",),
}

WORD = re.compile(r"[a-z0-9]+")
PLACED = re.compile(r"[A-Za-z0-9]+")
COPYRIGHT = re.compile(r"^[^\w\n]*(?:copyright\b|©|\(c\)).*$", re.IGNORECASE | re.MULTILINE)


def words(text: str) -> list[str]:
    """Lower-case ASCII words and numbers; lines that only claim copyright are left out."""
    lowered = text.lower()
    if "copyright" in lowered or "©" in lowered or "(c)" in lowered:
        lowered = COPYRIGHT.sub("", lowered)
    return WORD.findall(lowered)


def bigrams(found: list[str]) -> Counter[tuple[str, str]]:
    return Counter(zip(found, found[1:]))


class Templates:
    """Templates with the index and the size bounds that prune them."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = {}
        self.counts: list[Counter[tuple[str, str]]] = []
        for name in sorted(templates):
            for text in templates[name]:
                counts = bigrams(words(text))
                for pair, n in counts.items():
                    self.index.setdefault(pair, []).append((len(self.names), n))
                self.names.append(name)
                self.sizes.append(counts.total())
                self.counts.append(counts)
        ratio = (2 - threshold) / threshold
        #: Sizes of parts that some template can reach.
        self.reachable = {n for size in self.sizes for n in range(int(size / ratio), int(size * ratio) + 2) if self.near(n, size)}
        self.most = max(self.reachable, default=0)

    def near(self, n: int, size: int) -> bool:
        return n > 0 and 2 * min(n, size) >= self.threshold * (n + size)

    def matches(self, part: str) -> dict[str, float]:
        """Licences at the threshold or above, with the coefficient of their best template."""
        found = words(part)
        n = len(found) - 1
        if n not in self.reachable:
            return {}
        common: Counter[int] = Counter()
        for pair, count in bigrams(found).items():
            for number, there in self.index.get(pair, ()):
                if self.near(n, self.sizes[number]):
                    common[number] += min(count, there)
        best: dict[str, float] = {}
        for number, shared in common.items():
            dice = 2 * shared / (n + self.sizes[number])
            if dice >= self.threshold:
                best[self.names[number]] = max(dice, best.get(self.names[number], 0.0))
        return best

    def runs(self, text: str, known: set[str]) -> dict[str, tuple[float, int, int]]:
        """(coefficient, start, end) of the best run of words of each licence that is not known yet.

        A run starts and ends with a bigram of the template.  Two pointers give
        the common bigrams of the longest run from each start; only starts whose
        longest run could beat the best one so far are looked at end by end.
        """
        places = placed_words(text)
        pairs = [(a[0], b[0]) for a, b in zip(places, places[1:])]
        codes: dict[tuple[str, str], int] = {}
        coded = array("I", [codes.setdefault(pair, len(codes)) for pair in pairs])
        anchors: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            for number, _ in self.index.get(pair, ()):
                anchors.setdefault(number, []).append(i)
        best: dict[str, tuple[float, int, int]] = {}
        for number, at in anchors.items():
            name, size, counts = self.names[number], self.sizes[number], self.counts[number]
            least = math.ceil(self.threshold * size / 2)  # fewer common bigrams reach no coefficient
            if name in known or len(at) < least:
                continue
            longest = int(size * (2 - self.threshold) / self.threshold)
            inside: Counter[tuple[str, str]] = Counter()
            tried: set[bytes] = set()  # digests of longest runs; a repeated one gives nothing better
            shared = k = 0
            for i, first in enumerate(at):
                while k < len(at) and at[k] - first < longest:
                    pair = pairs[at[k]]
                    inside[pair] += 1
                    shared += inside[pair] <= counts[pair]
                    k += 1
                top = best.get(name, (self.threshold,))[0]
                if shared >= least and (2 * shared > top * (shared + size) or (name not in best and 2 * shared >= top * (shared + size))):
                    run = hashlib.blake2b(coded[first : at[k - 1] + 1].tobytes(), digest_size=16).digest()
                    if run not in tried:
                        tried.add(run)
                        self._ends(name, size, counts, pairs, places, at[i:k], best)
                pair = pairs[first]
                shared -= inside[pair] <= counts[pair]
                inside[pair] -= 1
        return best

    def _ends(self, name: str, size: int, counts: Counter, pairs: list, places: list, at: list[int], best: dict) -> None:
        """Enter the best run from the first of these anchors, if it beats the best one so far."""
        seen: Counter[tuple[str, str]] = Counter()
        shared, first = 0, at[0]
        for last in at:
            seen[pairs[last]] += 1
            shared += seen[pairs[last]] <= counts[pairs[last]]
            dice = 2 * shared / (last - first + 1 + size)
            if dice >= self.threshold and dice > best.get(name, (0.0,))[0]:
                best[name] = dice, places[first][1], places[last + 1][2]


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """The words of :func:`words` with their places in the text."""
    out = [(m.start(), m.end()) for m in COPYRIGHT.finditer(text)]
    found, line = [], 0
    for m in PLACED.finditer(text):
        while line < len(out) and out[line][1] <= m.start():
            line += 1
        if line == len(out) or m.start() < out[line][0]:
            found.append((m[0].lower(), m.start(), m.end()))
    return found


def parts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the whole text, its paragraphs and its lines, each stretch once, longer ones first."""
    lines, paragraphs, at, opened = [], [], 0, None
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            lines.append((at, end))
            opened = (at if opened is None else opened[0], end)
        elif opened is not None:
            paragraphs.append(opened)
            opened = None
        at = end + 1
    if opened is not None:
        paragraphs.append(opened)
    return list(dict.fromkeys([(0, len(text)), *paragraphs, *lines]))


def scan(text: str | None, templates: Templates) -> list[tuple[str, float, int, int]]:
    """(licence, coefficient, start, end) of each licence's best part, best first."""
    best: dict[str, tuple[float, int, int]] = {}
    # a part of n words has 2n - 1 characters at least
    for start, end in parts(text or ""):
        if end - start < 3:
            continue
        for name, dice in templates.matches(text[start:end]).items():
            if name not in best or dice > best[name][0]:
                best[name] = dice, start, end
    best |= templates.runs(text or "", set(best))
    return sorted(((name, *found) for name, found in best.items()), key=lambda x: (-x[1], x[0]))


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(key, licenses) per row: one pass, no shuffle."""
    known = Templates(templates, threshold)
    kind = df.schema[key].dataType.simpleString()
    return map_rows(
        df.select(F.col(key), F.col(text)),
        lambda k, t: (k, scan(t, known)),
        f"`{key}` {kind}, licenses array<struct<name:string,dice:double,start:bigint,end:bigint>>",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document with its coefficient and place, and all licences found in it."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    best = F.get("licenses", F.lit(0))
    return found.select(
        "doc_id",
        best["name"].alias("license"),
        F.coalesce(best["dice"], F.lit(0.0)).alias("dice"),
        best["start"].alias("span_start"),
        best["end"].alias("span_end"),
        F.array_join(F.sort_array(F.transform("licenses", lambda x: x["name"])), ",").alias("licenses"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BIGRAMS = r"regexp_extract_all(regexp_replace(lower({0}), '(?m)^[^\w\n]*(copyright\b|©|\(c\)).*$', '', 'g'), '[a-z0-9]+')"
SQL = f"""
WITH templates AS (SELECT row_number() OVER () AS number, name, {_BIGRAMS.format("body")} AS w FROM (VALUES
  {", ".join(f"({_literal(name)}, {_literal(body)})" for name, bodies in TEMPLATES.items() for body in bodies)}) t(name, body)),
template_pairs AS (
  SELECT number, name, len(w) - 1 AS size, pair, count(*) AS n
  FROM (SELECT *, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM templates)
  GROUP BY number, name, len(w), pair),
-- lines with their places, then runs of lines without a blank one, then the whole text
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, i, ls[i] AS line, CAST(coalesce(list_sum(list_transform(ls[1 : i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM split)),
full_lines AS (
  SELECT *, start + length(line) AS stop, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM lines WHERE regexp_matches(line, '\\S')),
stretches AS (
  SELECT doc_id, 0 AS rank, 0 AS start, length(text) AS stop FROM split
  UNION ALL SELECT doc_id, 1, min(start), max(stop) FROM full_lines GROUP BY doc_id, run
  UNION ALL SELECT doc_id, 2, start, stop FROM full_lines),
parts AS (
  SELECT s.doc_id, min(rank) AS rank, start, stop, {_BIGRAMS.format("any_value(substr(d.text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)))")} AS w
  FROM stretches s JOIN documents d USING (doc_id) GROUP BY s.doc_id, start, stop),
part_pairs AS (
  SELECT doc_id, rank, start, stop, len(w) - 1 AS size, pair, count(*) AS n
  FROM (SELECT *, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM parts WHERE len(w) > 1)
  GROUP BY doc_id, rank, start, stop, len(w), pair),
scored AS (
  SELECT p.doc_id, p.rank, p.start, p.stop, t.name, 2 * sum(least(p.n, t.n)) / (p.size + t.size) AS dice
  FROM part_pairs p JOIN template_pairs t USING (pair)
  GROUP BY p.doc_id, p.rank, p.start, p.stop, p.size, t.number, t.name, t.size),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY dice DESC, rank, start) AS r FROM scored WHERE dice >= {THRESHOLD})
  WHERE r = 1),
named AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM best GROUP BY doc_id)
SELECT d.doc_id, b.name AS license, CAST(coalesce(b.dice, 0) AS DOUBLE) AS dice, CAST(b.start AS BIGINT) AS span_start,
       CAST(b.stop AS BIGINT) AS span_end, coalesce(n.licenses, '') AS licenses
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.place = 1 LEFT JOIN named n ON n.doc_id = d.doc_id
"""
