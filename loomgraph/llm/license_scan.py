"""Licence scan: lines, paragraphs and sentences of a text against licence notices, by Dice coefficient over word bigrams.

Everything happens inside the row of a document, with built-in functions: no shuffle, no Python. A unit and a template with
a and b bigrams reach at most 2 * min(a, b) / (a + b), so only units within the size bounds of some template are cut into
bigrams, and only templates within the bounds of a unit are compared with it. A match shares at least least * (a + b) / 2
bigrams, so a unit with fewer bigrams that any template knows is compared with none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, UPPER, lower_ascii

# Public licence notices, standard headers and the paragraphs of licence texts. The licence is named before ``:``.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT:permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
        the Software is furnished to do so, subject to the following conditions:""",
    "MIT:notice": """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "MIT:warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC:permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "0BSD:permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted.""",
    "ISC:warranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD:source": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.""",
    "BSD:binary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause:names": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "BSD:warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0:header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "Apache-2.0:warranty": """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "GPL-3.0:header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0:header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "LGPL-2.1:header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version.""",
    "AGPL-3.0:header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
    "GPL:warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0:header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense:head": """This is free and unencumbered software released into the public domain.""",
    "Zlib:warranty": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.""",
    "Zlib:permission": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:""",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
MIN_DICE = 0.8
FOUND = "array<struct<dice:double,rank:int,license:string>>"


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as texts are."""
    words = re.sub(r"[\W_]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams with which a unit can reach ``least`` against a template of ``size``."""
    return next(a for a in range(1, size + 1) if 2 * a >= least * (a + size)), max(a for a in range(size, 20 * size) if 2 * size >= least * (a + size))


def units(text: Column) -> Column:
    """Lines and paragraphs (blocks between blank lines) as normalised text: A-Z lowered, all but letters and digits one space."""
    plain = F.regexp_replace(lower_ascii(text), r"[^\p{L}\p{N}\n]+", " ")
    tidy = F.regexp_replace(plain, r" ?\n ?", "\n")
    paragraphs = F.filter(F.split(tidy, "\n{2,}"), lambda p: F.contains(p, F.lit("\n")))
    return F.concat(F.split(tidy, "\n"), F.transform(paragraphs, lambda p: F.translate(p, "\n", " ")))


def sentences(text: Column) -> Column:
    """Sentences of the paragraphs, normalised; one may run over lines. They end at one of ``.!?;:`` before a blank."""
    marked = F.regexp_replace(lower_ascii(text), r"[.!?;:]+([ \t\n])", "\x01$1")
    tidy = F.regexp_replace(F.regexp_replace(marked, r"[^\p{L}\p{N}\n\x01]+", " "), r" ?\n ?", "\n")
    return F.split(F.translate(F.regexp_replace(tidy, "\n{2,}", "\x01"), "\n", " "), "\x01")


def licenses(found_in: Column, templates: dict[str, str] = TEMPLATES, least: float = MIN_DICE) -> Column:
    """The best template of every unit that reaches ``least``, as an array of (dice, rank, license); of equal ones the first."""
    prepared = [(name, b, *bounds(len(b), least)) for name, b in ((n, bigrams_of(t)) for n, t in templates.items())]
    low, high, smallest = min(p[2] for p in prepared), max(p[3] for p in prepared), min(len(p[1]) for p in prepared)
    known = sorted({g for p in prepared for g in p[1]})
    # Repeated bigrams only make a set smaller: a unit with fewer than low + 1 words cannot have low bigrams.
    words = F.filter(F.transform(found_in, lambda u: F.split(F.trim(u), " ")), lambda w: F.size(w) > low)
    # A shared bigram starts with a word of some template, and a unit has at least as many bigrams as distinct words less one.
    vocabulary = sorted({g.split(" ")[0] for g in known})
    words = F.filter(words, lambda w: F.lit(2.0) * F.size(F.filter(w, lambda x: x.isin(vocabulary))) >= F.lit(least) * (F.size(F.array_distinct(w)) + F.lit(smallest - 1)))
    pairs = F.transform(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    sized = F.filter(pairs, lambda b: F.size(b).between(low, high))
    # Of a unit, only its size and the bigrams that some template knows matter from here.
    shared = F.transform(sized, lambda b: F.struct(F.size(b).alias("size"), F.filter(b, lambda g: g.isin(known)).alias("known")))
    likely = F.filter(shared, lambda u: F.lit(2.0) * F.size(u["known"]) >= F.lit(least) * (u["size"] + F.lit(smallest)))

    def best(u: Column) -> Column:
        found = []
        for rank, (name, grams, a, z) in enumerate(prepared):
            common = F.size(F.array_intersect(u["known"], F.array(*map(F.lit, grams))))
            dice = F.when(u["size"].between(a, z), F.lit(2.0) * common / (u["size"] + F.lit(len(grams)))).otherwise(0.0)
            found.append(F.struct(dice.alias("dice"), F.lit(-rank).alias("rank"), F.lit(name).alias("license")))
        return F.array_max(F.array(*found))

    return F.filter(F.transform(likely, best), lambda m: m["dice"] >= least).cast(FOUND)


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = MIN_DICE) -> DataFrame:
    """doc_id, n_matches (lines and paragraphs that match), license and dice of the best of them, licenses, for every row.

    ``licenses`` names every licence found in a line, a paragraph or a sentence, in order, with commas; a template belongs to
    the licence before its colon. A notice inside a longer sentence is found only if the whole sentence is like it. Null and
    empty texts match nothing (license null, dice 0, licenses empty). Ties go to the template listed first. Repeated rows are
    scanned each; null ids stay null; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    found = documents.select("doc_id", licenses(units(text), templates, least).alias("_found"), licenses(sentences(text), templates, least).alias("_said"))
    best = F.array_max("_found")
    names = F.array_sort(F.array_distinct(F.transform(F.concat("_found", "_said"), lambda m: F.substring_index(m["license"], ":", 1))))
    return found.select("doc_id", F.size("_found").cast("long").alias("n_matches"), best["license"].alias("license"), F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), F.array_join(names, ",").alias("licenses"))


def _oracle() -> str:
    rows = ", ".join(f"({k}, '{n}', [{', '.join(repr(b) for b in bigrams_of(t))}])" for k, (n, t) in enumerate(TEMPLATES.items()))
    return rf"""
WITH template(rank, license, grams) AS (VALUES {rows}),
lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
tidy AS (
  SELECT r, regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t,
         regexp_replace(regexp_replace(regexp_replace(t, '[.!?;:]+([ \t\n])', chr(1) || '\1', 'g'), '[^\p{{L}}\p{{N}}\n\x01]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS marked
  FROM lowered),
unit AS (
  SELECT r, unnest(string_split(t, chr(10))) AS u, false AS said FROM tidy
  UNION ALL
  SELECT r, replace(p, chr(10), ' '), false FROM (SELECT r, unnest(regexp_split_to_array(t, '\n{{2,}}')) AS p FROM tidy) WHERE contains(p, chr(10))
  UNION ALL
  SELECT r, unnest(string_split(replace(regexp_replace(marked, '\n{{2,}}', chr(1), 'g'), chr(10), ' '), chr(1))), true FROM tidy),
worded AS (SELECT row_number() OVER () AS k, r, said, string_split(trim(u, ' '), ' ') AS w FROM unit),
pairs AS (
  SELECT k, r, said, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM worded WHERE len(w) > 2),
rated AS (
  SELECT k, r, said, rank, license, 2.0::DOUBLE * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS dice FROM pairs JOIN template ON len(b) < 20 * len(grams)),
hits AS (SELECT r, said, license, dice, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dice DESC, rank) AS o FROM rated) WHERE o = 1 AND dice >= {MIN_DICE}),
best AS (SELECT r, count(*) AS n, arg_min(license, (-dice, rank)) AS license, max(dice) AS dice FROM hits WHERE NOT said GROUP BY r),
named AS (SELECT r, array_to_string(list_sort(list(DISTINCT string_split(license, ':')[1])), ',') AS names FROM hits GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, license, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(names, '') AS licenses
FROM lowered LEFT JOIN best USING (r) LEFT JOIN named USING (r)
"""


ORACLE = _oracle()
