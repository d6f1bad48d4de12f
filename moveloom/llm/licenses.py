r"""Licence scans (operator 8), in DataFrame functions only.

The units of a document are its lines, its paragraphs, the whole text, and for each template the windows of
as many words as it has that place one of its rare words where the template has it. Of windows that overlap by
more than half, only the likest licence's count, and a window within a longer one of another licence does not
(the two clauses of one licence stand in the three of another). Long licences, whose files are looked for by a
passage of them, need no other form. A unit and a template are
normalised to lower-case words of letters and digits; their likeness is the Dice coefficient of their sets
of word bigrams. Dice reaches t only if the smaller set is at least t / (2 - t) of the larger, so for each
unit only the templates within those bounds are compared; most units have none. A unit that reaches t also
shares so many bigrams with the template that it must hold one of any few of them: texts without the words
of such a few are passed over before anything is split.

Defined cases: a null or empty text has no units and no rows; units of fewer than two words have no
bigrams; a licence found several times in a document gives one row with its best score; equal rows give a
row each per id; an empty table gives an empty table; long texts are compared whole.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices and texts of common licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


_WARRANTY = "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


def _header(work: str, kind: str, version: str) -> str:
    return f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {work} is {_WARRANTY} See the GNU {kind} for more details."


#: The usual headers that TEMPLATES lacks; the SQL doesn't have them.
HEADERS = {
    "GPL-2.0": (_header("program", "General Public License", "2"),),
    "LGPL-2.1": (_header("library", "Lesser General Public License", "2.1"),),
    "LGPL-3.0": (_header("program", "Lesser General Public License", "3"), _header("library", "Lesser General Public License", "3")),
}
#: What licence files say beyond TEMPLATES and HEADERS, of long ones a passage; the SQL doesn't have them.
PASSAGES = {
    "Apache-2.0": (
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "GPL-2.0": (
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of the Program a copy of this License along with the Program.",
    ),
    "GPL-3.0": (
        "All rights granted under this License are granted for the term of copyright on the Program, and are irrevocable provided the stated conditions are met. This License explicitly affirms your unlimited permission to run the unmodified Program. The output from running a covered work is covered by this License only if the output, given its content, constitutes a covered work. This License acknowledges your rights of fair use or other equivalent, as provided by copyright law.",
    ),
    "MPL-2.0": (
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: (a) under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work;",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}
ALL_TEMPLATES = {name: TEMPLATES.get(name, ()) + HEADERS.get(name, ()) + PASSAGES.get(name, ()) for name in sorted({*TEMPLATES, *HEADERS, *PASSAGES})}


#: Words too common to tell a licence by.
COMMON = ("a", "and", "by", "in", "is", "of", "or", "the", "this", "to", "with")


def template_bigrams(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    out = []
    for name, texts in templates.items():
        for text in texts:
            words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
            out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return out


def anchor_words(own: list[str], threshold: float) -> list[str]:
    """Words one of which every text has that reaches the threshold with a template of these bigrams.

    Such a text shares at least `least` bigrams, so it shares one of any len(own) - least + 1; the longest
    words are taken, common ones last, until the bigrams that hold them are so many.
    """
    n = len(own)
    sizes = range(math.ceil(n * threshold / (2 - threshold) - 1e-9), n + 1)
    least = min(math.ceil(threshold * (size + n) / 2 - 1e-9) for size in sizes)
    words, held = [], set()
    for word in sorted({w for b in own for w in b.split(" ")}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(held) > n - least:
            break
        words.append(word)
        held |= {b for b in own if word in b.split(" ")}
    return words


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a text."""
    words = F.array_remove(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), "")
    pairs = F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("x"), F.slice(words, F.lit(2), F.size(words) - 1).alias("y"))
    return F.when(F.size(words) > 1, F.array_distinct(F.transform(pairs, lambda p: F.concat_ws(" ", p["x"], p["y"])))).otherwise(F.array().cast("array<string>"))


def _window_hits(words: Column, templates: dict[str, tuple[str, ...]], threshold: float) -> Column:
    """(dice, license, start, end) of the windows of a text's words that reach the threshold."""
    places: dict[str, list[tuple[int, int]]] = {}
    listed = [(name, [w for w in re.split(r"[^\w]|_", text.lower()) if w]) for name, texts in templates.items() for text in texts]
    for k, ((_, own), (_, pairs)) in enumerate(zip(listed, template_bigrams(templates), strict=True)):
        for word in anchor_words(pairs, threshold):
            places.setdefault(word, []).extend((k, at) for at, w in enumerate(own) if w == word)
    found = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*places))
    known = F.create_map(*(c for w, own in places.items() for c in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(at).alias("at")) for k, at in own)))))
    starts = F.array_distinct(F.flatten(F.transform(found, lambda x: F.transform(known[x["w"]], lambda p: F.struct(p["k"].alias("k"), (x["i"] - p["at"]).alias("start"))))))
    lengths, names = F.array(*(F.lit(len(own)) for _, own in listed)), F.array(*(F.lit(name) for name, _ in listed))
    sets = F.array(*(F.array(*map(F.lit, own)) for _, own in template_bigrams(templates)))

    def hit(c: Column) -> Column:
        low, end = F.greatest(c["start"], F.lit(0)), c["start"] + F.get(lengths, c["k"])
        own = F.get(sets, c["k"])
        there = F.transform(F.array(bigrams(F.array_join(F.slice(words, low + 1, end - low), " "))), lambda b: 2.0 * F.size(F.array_intersect(b, own)) / (F.size(b) + F.size(own)))
        return F.struct(there[0].alias("dice"), F.get(names, c["k"]).alias("license"), low.alias("start"), F.least(end, F.size(words)).alias("end"))

    return F.filter(F.transform(starts, hit), lambda h: h["dice"] >= threshold)


def _likest(hits: DataFrame, longest: int) -> DataFrame:
    """hits (doc_id, text_key, hit) less those that a likelier hit of another licence overlaps by more than half, or a much longer one holds.

    Windows have at most `longest` words, so what meets one begins in its stretch of so many words or in a neighbour; a
    text of many notices is compared stretch by stretch.
    """

    def beaten(x: Column, y: Column) -> Column:
        both = F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])
        more = (y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["license"] > x["license"]))
        own, other = x["end"] - x["start"], y["end"] - y["start"]
        half, holds = 2 * both > F.least(own, other), (10 * both >= 9 * own) & (4 * other >= 5 * own)
        longer = (10 * both >= 9 * other) & (4 * own >= 5 * other)
        return (y["license"] != x["license"]) & (holds | (more & half & ~longer))

    own = F.floor(F.col("hit.start") / longest)
    near = hits.distinct().select("doc_id", "text_key", "hit", own.alias("home"), F.explode(F.array(own - 1, own, own + 1)).alias("stretch"))
    met = near.groupBy("doc_id", "text_key", "stretch").agg(F.collect_list(F.struct("hit", (F.col("home") == F.col("stretch")).alias("own"))).alias("hits"))
    kept = F.filter("hits", lambda x: x["own"] & ~F.exists("hits", lambda y: beaten(x["hit"], y["hit"])))
    return met.select("doc_id", "text_key", F.explode(F.transform(kept, lambda x: x["hit"])).alias("hit"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] = ALL_TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> (doc_id, license, dice): the best score of each licence that reaches the threshold."""
    known = template_bigrams(templates)
    ratio = threshold / (2 - threshold)
    body = F.coalesce(F.col(text), F.lit(""))
    units = F.array_distinct(F.concat(F.split(body, "\n"), F.split(body, r"\n\s*\n"), F.array(body)))
    words = {w for _, own in known for w in anchor_words(own, threshold)}
    words = sorted(w for w in words if not any(v != w and v in w for v in words))
    # a lambda's variable holds the lower-cased text once for all words
    held = F.exists(F.array(F.lower(body)), lambda t: functools.reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words)))
    texts = docs.where(held)
    split = texts.select(F.col(doc_id).alias("doc_id"), F.md5(body).alias("text_key"), F.explode_outer(F.array(F.array_remove(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), ""))).alias("words"))
    hits = split.select("doc_id", "text_key", F.explode_outer(F.array(_window_hits(F.col("words"), templates, threshold))).alias("hits")).where(F.size("hits") > 0)
    hits = hits.select("doc_id", "text_key", F.explode_outer("hits").alias("hit"))
    longest = max(len(re.findall(r"[^\W_]+", text)) for texts_ in templates.values() for text in texts_)
    within_text = _likest(hits, longest).select("doc_id", F.struct("hit.dice", "hit.license").alias("hit"))
    single = texts.select(F.col(doc_id).alias("doc_id"), F.explode_outer(units).alias("unit"))
    # explode() of one element keeps the filter below from being computed with the set once per condition
    sets = single.select("doc_id", F.explode_outer(F.array(bigrams(F.col("unit")))).alias("set")).withColumn("n", F.size("set"))
    near = F.lit(False)
    for low, high in sorted({(len(b) * ratio, len(b) / ratio) for _, b in known}):
        near = near | F.col("n").between(low, high)
    sets = sets.where(near)
    scores = []
    for name, own in known:
        within = F.col("n").between(len(own) * ratio, len(own) / ratio)
        shared = F.size(F.array_intersect("set", F.array(*map(F.lit, own))))
        scores.append(F.when(within, F.struct((2.0 * shared / (F.col("n") + len(own))).alias("dice"), F.lit(name).alias("license"))))
    best = F.array_max(F.array(*scores))  # of the licences that reach the threshold, a unit counts for the likest
    found = sets.select("doc_id", best.alias("hit")).union(within_text).where(F.col("hit.dice") >= threshold)
    return found.groupBy("doc_id", F.col("hit.license").alias("license")).agg(F.max("hit.dice").alias("dice"))
