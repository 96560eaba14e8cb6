"""License scans, with DataFrame functions only: MinHash bands over text windows retrieve templates, exact containment verifies.

Texts and templates are words of ASCII letters and digits in lower case; shingles
are five words. Every template, of any length, gets the least window length that
holds it, at most half as long again; windows of each length start every quarter of
their length. A window's signature holds ``BANDS`` minima of one row each. Were the
minima independent, a window that shares a third of the union of shingles with a
template would miss it with probability (2/3)^24 = 6e-5, and one that shares half with
6e-8. They are minima under masks of one hash: measured on random sets of 10 to 150
shingles, none of 20,000 pairs of each size was missed at a third or at half; of five
shingles, 2 in 8 shared, 0.3 %. Retrieved templates are then compared
exactly: the share of a template's shingles that the whole document holds must be
0.8 or more.

Only windows near an anchor word are built. That loses nothing: for every template
more than a fifth of the shingles hold an anchor (checked when templates are
read), so a text that holds four fifths of them holds an anchor too. Whole licenses of ``LONG`` words and more
(the texts in ``license_texts``) also count ``WIDE_ANCHORS``, commoner words that only texts long enough are searched for.

Defined cases: null, empty and short texts match nothing; rows that repeat a doc_id
give one row per template, of the best match; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlode.llm.common import materialize

WORDS, LEAST, BANDS = 5, 0.8, 24
#: Window lengths: each is half as long again as the one before, from this one up to what the templates need.
SHORTEST = 6
ANCHORS = ("license", "licensed", "copyright", "software", "warranty", "warranties", "liability", "liable", "disclaimer", "disclaimed", "permission", "redistribution", "redistributions", "damages", "modification", "mpl", "eclipse")
#: Every anchor begins with one of these; a text without them needs no splitting.
BEGINNINGS = ("licens", "copyright", "software", "warrant", "liab", "disclaim", "permission", "redistribution", "damages", "modification", "mpl", "eclipse")

#: Templates of so many words are whole licenses, in which these words count as well.
LONG = 500
WIDE_ANCHORS = ("library", "program", "cover", "contributor", "invariant", "package", "affirmer", "waiver", "distribute")

#: Notices of public licenses: fixed values.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-whole": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-whole": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense-whole": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


@cache
def whole_texts() -> dict[str, str]:
    """Public licenses in full, from the package's ``license_texts``."""
    folder = Path(__file__).parent / "license_texts"
    return {f"{path.name.removesuffix('.txt')}-text": path.read_text(encoding="utf-8") for path in sorted(folder.glob("*.txt"))}


def all_templates() -> dict[str, str]:
    return TEMPLATES | whole_texts()


def window_for(n_words: int) -> int:
    """The least window length that holds a template of so many words."""
    n = SHORTEST
    while n < n_words:
        n += -(-n // 2)
    return n


def check_templates(templates: dict[str, str]) -> None:
    """Anchors must touch more than a fifth of each template's shingles."""
    for name, text in templates.items():
        w = template_words(text)
        shingles = {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)}
        anchors = {*ANCHORS, *WIDE_ANCHORS} if len(w) >= LONG else ANCHORS
        if not shingles or sum(any(x in anchors for x in s) for s in shingles) <= (1 - LEAST) * len(shingles):
            raise ValueError(f"no anchor covers the template {name}")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def hashes(w: Column) -> Column:
    """Shingle hashes by place."""
    return F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(w, i, WORDS)))).otherwise(F.array().cast("array<bigint>"))


MASKS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 - 2**63 for k in range(BANDS))


def minima(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, window and a (band, least value) hash for each band and window.

    ``rows`` has h (hashes by place) and windows (window, first, n). A band's least value is
    the least of the hashes under the band's mask, which permutes them; the hashes
    are masked once per row, then a window is only a minimum over a slice.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(m).alias("mask")) for k, m in enumerate(MASKS)])
    rows = rows.select(*keep, "h", "windows", F.explode(masks).alias("b"))
    # Exploded, though it is one array: what a generator makes isn't worked out again for each window.
    rows = rows.select(*keep, "windows", "b.band", F.explode(F.array(F.transform("h", lambda x: x.bitwiseXOR(F.col("b.mask"))))).alias("masked"))
    least = lambda w: F.struct(w["window"].alias("window"), F.xxhash64("band", F.array_min(F.slice("masked", w["first"] + 1, w["n"]))).alias("key"))
    return rows.select(*keep, F.explode(F.transform("windows", least)).alias("w")).select(*keep, "w.window", "w.key")


def windows_near(n: int) -> Column:
    """Windows of n words that begin within n words of an anchor: (window, first, n), n the number of shingles. Windows of whole licenses look at all anchors."""
    step = max(1, n // 4)
    reach = F.sequence(F.lit(-(n // step) - 1), F.lit(n // step + 1))
    starts = F.transform("anchors" if n < LONG else "wide", lambda p: F.transform(reach, lambda k: F.greatest(F.lit(0), (F.floor(p / step).cast("int") + k) * step)))
    starts = F.filter(F.array_distinct(F.flatten(starts)), lambda i: i < F.size("h"))
    return F.transform(starts, lambda i: F.struct(F.lit(n).alias("window"), i.alias("first"), F.lit(max(1, n - WORDS + 1)).alias("n")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, window, shingles (distinct hashes): a constant table."""
    check_templates(templates)
    rows = [(name, window_for(len(w)), w) for name, w in ((name, template_words(text)) for name, text in templates.items())]
    table = spark.createDataFrame(rows, "template string, window int, w array<string>")
    return materialize(table.select("template", "window", F.array_distinct(hashes(F.col("w"))).alias("shingles")), "license-templates")


def _anchored(w: str, anchors: tuple[str, ...], at_least: int) -> Column:
    """Places of anchors in a text of ``at_least`` words; none in a shorter one."""
    places = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(*anchors), i)))
    return F.when(F.size(w) >= at_least, places).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template, n_shingles (the template's), containment, first_word (place of the first shared shingle, from 0)."""
    spark = docs.sparkSession
    templates = all_templates() if templates is None else templates
    # A text that holds four fifths of a long template's distinct shingles has as many words.
    long = [len({*zip(*(w[k:] for k in range(WORDS)))}) for w in map(template_words, templates.values()) if len(w) >= LONG]
    least = int(LEAST * min(long)) if long else 1 << 30
    known = template_table(spark, templates)
    used = sorted({window_for(len(template_words(t))) for t in templates.values()})
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(reduce(or_, (F.lower("text").contains(x) for x in BEGINNINGS)) | ((F.char_length("text") >= 2 * least) & reduce(or_, (F.lower("text").contains(x) for x in WIDE_ANCHORS))))
    near = materialize(near.select("doc_id", words(F.col("text")).alias("w")), "license-words")
    near = near.select("doc_id", hashes(F.col("w")).alias("h"), _anchored("w", ANCHORS, 1).alias("anchors"), _anchored("w", (*ANCHORS, *WIDE_ANCHORS), least).alias("wide"))
    near = near.where((F.size("h") > 0) & ((F.size("anchors") > 0) | (F.size("wide") > 0)))
    near = materialize(near, "license-hashes")  # in tables, or the optimizer would put the splitting into every use
    keys = minima(near.select("doc_id", "h", F.concat(*map(windows_near, used)).alias("windows")), ["doc_id"])
    whole = F.array(F.struct("window", F.lit(0).alias("first"), F.size("shingles").alias("n")))
    bands = minima(known.select("template", F.col("shingles").alias("h"), whole.alias("windows")), ["template"])
    # The constant table of templates: BANDS rows each.
    found = keys.join(F.broadcast(bands), ["window", "key"]).select("doc_id", "template").distinct()
    shared = F.array_intersect("shingles", "h")
    out = near.join(found, "doc_id").join(F.broadcast(known.select("template", "shingles")), "template")
    out = out.select("doc_id", "template", F.size("shingles").cast("long").alias("n_shingles"), (F.size(shared) / F.size("shingles")).alias("containment"), F.array_min(F.transform(shared, lambda x: F.array_position("h", x) - 1)).alias("first_word"))
    best = F.struct("containment", (-F.col("first_word")).alias("first"))
    out = out.where(F.col("containment") >= LEAST).groupBy("doc_id", "template", "n_shingles").agg(F.max(best).alias("x"))
    return out.select("doc_id", "template", "n_shingles", F.col("x.containment").alias("containment"), (-F.col("x.first")).alias("first_word"))


def oracle(templates: dict[str, str] | None = None) -> str:
    """The same rows by comparing every shingle of every document, as DuckDB SQL."""
    templates = all_templates() if templates is None else templates
    rows = ", ".join("('{}', ['{}'])".format(name, "', '".join(template_words(text))) for name, text in templates.items())
    return f"""
WITH templates(template, w) AS (VALUES {rows}),
wanted AS (SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s FROM templates, unnest(generate_series(1, len(w) - 4)) AS g(i)),
sizes AS (SELECT template, count(*) AS n FROM wanted GROUP BY template),
words AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
shingles AS (SELECT doc_id, rid, i - 1 AS place, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(generate_series(1, len(w) - 4)) AS g(i)),
found AS (
  SELECT doc_id, rid, template, count(DISTINCT s) AS k, min(place) AS first_word
  FROM shingles JOIN wanted USING (s) GROUP BY doc_id, rid, template),
good AS (SELECT doc_id, template, n, CAST(k AS DOUBLE) / n AS containment, first_word FROM found JOIN sizes USING (template) WHERE CAST(k AS DOUBLE) / n >= {LEAST})
SELECT doc_id, template, CAST(n AS BIGINT) AS n_shingles, max(containment) AS containment, CAST(arg_max(first_word, containment * 1e9 - first_word) AS BIGINT) AS first_word
FROM good GROUP BY doc_id, template, n
"""
