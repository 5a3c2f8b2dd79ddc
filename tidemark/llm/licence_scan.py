"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

DataFrame functions only. A text is lower-cased and every run of other characters than a-z and 0-9 becomes a space, so notices are
found across line ends, in comments and inside paragraphs. The units that are compared with a template of n words are the windows
of n words of the text (fewer at its end) that begin with one of the template's bigrams.

Two bounds prune without dropping a match. Dice >= t needs sizes a and b (distinct bigrams) with a between b * t / (2 - t) and
b * (2 - t) / t; and it needs so many of the template's bigrams that one of them holds one of its keys: its longest words, so many
that the bigrams without them are too few. A template is compared only with texts that hold one of its keys.

A null, empty or unmatched text gives a null licence, a null dice and 0 matches; a text of a single word has no bigram. Ties go to
the first name in order. n_matches counts the templates that the text reaches. Very long texts are scanned whole; repeated rows
give a row each; an empty table gives none. Other columns have no part in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which texts name their licence, the opening of the licences' own texts, and whole short licences (fixed values).
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
}
THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(text: str, threshold: float) -> tuple[int, int]:
    """Fewest and most distinct bigrams of a window that can reach the threshold against the template."""
    b = len(bigrams_of(text))
    return -int(-b * threshold / (2 - threshold) // 1), int(b * (2 - threshold) / threshold + 1e-9)


def keys_of(text: str, threshold: float) -> list[str]:
    """Words of which a window that reaches the threshold holds one: without them too few of the template's bigrams are left."""
    grams, least = bigrams_of(text), bounds(text, threshold)[0]
    need = -int(-threshold * (least + len(grams)) / 2 // 1)
    keys: list[str] = []
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if sum(not set(g.split()) & set(keys) for g in grams) < need:
            break
        keys.append(word)
    return keys


def _best(grams: Column, text: str, threshold: float) -> Column:
    """The largest Dice coefficient of the text's windows, null below the threshold."""
    own, words, (low, high) = bigrams_of(text), len(words_of(text)), bounds(text, threshold)
    template = F.array(*map(F.lit, own))
    starts = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(template, F.element_at(grams, i)))
    windows = F.transform(starts, lambda i: F.array_distinct(F.slice(grams, i, words - 1)))
    fitting = F.filter(windows, lambda w: F.size(w).between(low, high))
    dice = F.array_max(F.transform(fitting, lambda w: F.lit(2.0) * F.size(F.array_intersect(w, template)) / (F.size(w) + len(own))))
    return F.when(dice >= threshold, dice)


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: key, licence, dice, n_matches (templates that the text reaches)."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    names = sorted(templates)
    every = sorted({w for name in names for w in keys_of(templates[name], threshold)})
    held = {w: F.contains(F.col("plain"), F.lit(f" {w} ")) for w in every}
    # Which keys the text holds, looked for once each; a template's own keys are then compared as words.
    words = F.split(F.trim(F.col("plain")), " ")
    grams = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    found = F.filter(F.array(*(F.when(held[w], F.lit(w)) for w in every)), lambda w: w.isNotNull())
    some = F.size("found") > 0
    scored = []
    for name in names:
        wanted = F.array(*map(F.lit, keys_of(templates[name], threshold)))
        dice = F.when(F.arrays_overlap(F.col("found"), wanted), _best(F.col("grams"), templates[name], threshold))
        scored.append(F.struct((-dice).alias("less"), F.lit(name).alias("licence")))
    hits = F.when(some, F.filter(F.array(*scored), lambda x: x["less"].isNotNull())).otherwise(F.slice(F.array(*(F.struct(F.lit(0.0).alias("less"), F.lit(n).alias("licence")) for n in names[:1])), 1, 0))
    return (
        docs.select(F.col(key), plain.alias("plain"))
        .select(key, "plain", found.alias("found"))
        .select(key, "found", F.when(some & (F.size(words) > 1), grams).otherwise(F.array().cast("array<string>")).alias("grams"))
        .select(key, F.when(F.size("grams") > 0, hits).alias("hits"))
        .select(key, F.array_min("hits").alias("best"), F.coalesce(F.when(F.size("hits") > 0, F.size("hits")), F.lit(0)).cast("bigint").alias("n_matches"))
        .select(key, F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("dice"), "n_matches")
    )


def sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows over `documents` in DuckDB's SQL."""
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    rows = []
    for name, text in sorted(templates.items()):
        low, high = bounds(text, threshold)
        rows.append(f"('{name}', [{listed(bigrams_of(text))}], [{listed(keys_of(text, threshold))}], {len(words_of(text))}, {low}, {high})")
    return rf"""
WITH t(licence, own, keys, n, low, high) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents),
c AS (SELECT row_id, words, licence, own, n, low, high FROM d, t WHERE len(words) > 1 AND list_has_any(words, keys)),
g AS (SELECT * EXCLUDE (words), [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] AS grams FROM c),
w AS (SELECT row_id, licence, own, low, high, list_distinct(grams[i : i + n - 2]) AS win FROM (SELECT *, unnest([i FOR i IN range(1, len(grams) + 1) IF list_contains(own, grams[i])]) AS i FROM g)),
s AS (SELECT row_id, licence, 2.0::DOUBLE * len(list_intersect(win, own)) / (len(win) + len(own)) AS dice FROM w WHERE len(win) BETWEEN low AND high),
b AS (SELECT row_id, licence, max(dice) AS dice FROM s WHERE dice >= {threshold} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dice DESC, licence) AS rn, count(*) OVER (PARTITION BY row_id) AS n_matches FROM b)
SELECT doc_id, licence, dice, coalesce(n_matches, 0)::BIGINT AS n_matches FROM d LEFT JOIN r ON r.row_id = d.row_id AND rn = 1
"""
