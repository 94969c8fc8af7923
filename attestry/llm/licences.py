"""Licence scans: windows of normalised text against licence templates by the Dice coefficient of their word bigrams.

DataFrame functions only, and no shuffle. A text's words are laid out once, over its lines, so a notice that is wrapped,
quoted behind comment marks or inside a longer paragraph is found. For a template of b distinct bigrams, two sets reach a Dice coefficient
t only if they share t/(2-t)*b bigrams: a template with fewer of its bigrams in the text is dropped before any window of it is looked at, and
a window is dropped before its set is made unless it holds that many occurrences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short licence notices as people put them into files and pages, and the bodies of short licences, as published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause-text": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means.""",
}
#: Least Dice coefficient, in percent.
LEAST = 80


def normalised(text: Column) -> Column:
    """Lower case; all but letters and digits become single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams_of(template: str) -> list[str]:
    """A template's pairs of neighbouring words, in order and with repeats."""
    words = re.sub(r"[\W_]+", " ", template.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def fewest_shared(distinct: int, least: int) -> int:
    """The fewest bigrams that a window must share with a template of so many distinct ones."""
    return -(-least * distinct // (200 - least))


def _with(value: Column, make) -> Column:
    """``make`` over ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _match(name: str, pairs: list[str], least: int, grams: Column, hits: Column) -> Column:
    """The best window of one template, or null."""
    distinct, span = sorted(set(pairs)), len(pairs)
    fewest, held = fewest_shared(len(distinct), least), F.split(F.lit("|".join(distinct)), r"\|")

    def windows(at: Column) -> Column:
        # the first and the last bigram of each window are the template's; it spans at most as many as the template
        ends = F.transform(at, lambda p, k: F.struct(p.alias("p"), F.get(at, k + (fewest - 1)).alias("q"), k.alias("k")))
        starts = F.filter(ends, lambda e: e["q"] - e["p"] < span)

        def scored(e: Column) -> Column:
            last = F.array_max(F.filter(F.slice(at, e["k"] + 1, F.lit(span)), lambda x: x - e["p"] < span))
            return _with(
                F.array_distinct(F.slice(grams, e["p"] + 1, last - e["p"] + 1)),
                lambda w: F.struct((F.lit(2.0) * F.size(F.array_intersect(w, held)) / (F.size(w) + len(distinct))).alias("dice"), F.lit(name).alias("name"), (-e["p"]).alias("place"), (last - e["p"] + 2).alias("n_words")),
            )

        return F.array_max(F.filter(F.transform(starts, scored), lambda s: F.round(s["dice"] * 1e9) >= least * 10_000_000))

    mine = F.filter(hits, lambda h: F.array_contains(held, h["g"]))
    return _with(F.transform(mine, lambda h: h["i"]), lambda at: F.when(F.size(at) >= fewest, windows(at)))


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, n_matches, licences, best_licence, best_dice, matches) of each row of ``docs`` (doc_id, text).

    A window begins and ends with a bigram of the template and spans at most as many as the template has: for each such beginning the
    longest one. A template matches when the Dice coefficient of one of its windows' distinct bigrams and its own is at least ``least`` percent;
    its best window (ties: the earliest) stands in ``matches``, an array of (name, dice, first_word from 0, n_words) by name. ``n_matches``:
    the templates matched; ``licences``: their names, sorted, joined by commas, empty if none; ``best_licence``, ``best_dice``: the match of the greatest
    coefficient (ties: the name that sorts last), null if none. A null text is an empty one; empty texts and single words match
    nothing. Repeated rows come back as often as they are there. The whole text is scanned. Columns besides doc_id and text are not read.
    Templates of fewer than two words are left out.
    """
    known = {name: pairs for name, text in sorted((templates or TEMPLATES).items()) if (pairs := bigrams_of(text))}
    every = sorted({p for pairs in known.values() for p in pairs})
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(normalised(F.coalesce("text", F.lit(""))), " ", -1).alias("w"))

    def matches(w: Column) -> Column:
        def of(grams: Column) -> Column:
            hits = F.filter(F.transform(grams, lambda g, i: F.when(g.isin(*every), F.struct(i.alias("i"), g.alias("g")))), lambda h: h.isNotNull())
            found = _with(hits, lambda hs: F.array(*(_match(name, pairs, least, grams, hs) for name, pairs in known.items())))
            return F.filter(found, lambda m: m.isNotNull())

        return _with(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, i: F.concat(a, F.lit(" "), F.get(w, i + 1))), of)

    out = words.select("doc_id", F.when(F.get("w", F.lit(0)) == "", 0).otherwise(F.size("w")).cast("long").alias("n_words"), matches(F.col("w")).alias("found"))
    best = F.array_max(F.transform("found", lambda m: F.struct(m["dice"], m["name"])))
    return out.select(
        "doc_id",
        "n_words",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.transform("found", lambda m: m["name"]), ",").alias("licences"),
        best["name"].alias("best_licence"),
        F.round(best["dice"], 9).alias("best_dice"),
        F.transform("found", lambda m: F.struct(m["name"].alias("name"), m["dice"].alias("dice"), (-m["place"]).cast("long").alias("first_word"), m["n_words"].cast("long").alias("n_words"))).alias("matches"),
    )
