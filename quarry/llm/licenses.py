"""Licence scans: normalised text against templates by the Dice coefficient of word bigrams, in built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices of public licences, and the whole texts of the short ones, as they are normally written.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License Version 2.0, January 2004"],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org'],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
}
LEAST_DICE = 0.8


def normal_words(text: str) -> list[str]:
    """What normal() gives, for the templates."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def normal(text: Column) -> Column:
    """The words of a text: runs of ASCII letters and digits, in lower case."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(text, letters.upper(), letters), F.lit("[a-z0-9]+"), 0)


def neighbours(words: Column) -> Column:
    """The pairs of neighbouring words in order; one word alone has none."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    return F.array_distinct(neighbours(words))


def held(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once: a lambda's variable is, an expression is as often as it stands there."""
    return F.transform(F.array(value), then)[0]


def template_bigrams(templates: Mapping[str, Sequence[str]] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    out = []
    for name, given in templates.items():
        for i, text in enumerate(given):
            words = normal_words(text)
            out.append((name, i, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return out


def needed_words(templates: list[tuple[str, int, list[str]]], least: float) -> list[str]:
    """Words without all of which no unit matches any template.

    A match shares b * least / (2 - least) of a template's b bigrams or more. A template is covered when its bigrams
    without any of the words are fewer; the word that covers most goes first.
    """
    left = [(set(b), len(b) * least / (2 - least)) for *_, b in templates]
    out: list[str] = []
    while left := [(b, n) for b, n in left if len(b) >= n]:
        words = sorted({w for b, _ in left for x in b for w in x.split()})
        gain = lambda w: sum(min(len(b) - n + 1, sum(w in x.split() for x in b)) / (len(b) - n + 1) for b, n in left) * (1 if len(w) > 5 else 0.3 if len(w) > 4 else 1e-3)  # noqa: B023, E731
        out.append(max(words, key=gain))
        left = [({x for x in b if out[-1] not in x.split()}, n) for b, n in left]
    return out


def windows(text: Column, lines: Column, units: Column, bigrams_of: list[tuple[str, int, list[str]]], least: float) -> Column:
    """What stands inside a text or a line: a struct of n and top, the best as (dice, own, at, line); null if nothing can be there.

    A template of b bigrams is tried at each of its bigrams in the text, whatever the lines: the window that begins there
    is the one of at most b * (2 - least) / least bigrams with the highest Dice, the shortest of equals. From `least` on
    it matches. n counts, from left to right, the windows that touch no unit that matches; of those that overlap, the
    better one stays, the earlier of equals. top is over all windows.
    """
    given = [(-i, b, math.ceil(len(b) * least / (2 - least) - 1e-9), math.floor(len(b) * (2 - least) / least + 1e-9)) for i, (*_, b) in enumerate(bigrams_of)]
    templates = F.array(*[F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, b)).alias("b"), F.lit(need).alias("need"), F.lit(most).alias("most")) for at, b, need, most in given])
    known = F.array(*map(F.lit, sorted({x for _, b, *_ in given for x in b})))

    def grown(a: Column, x: Column, b: Column) -> Column:
        """The window with one bigram more: it is new if it last stood before the window's start."""
        new = (x["back"] == 0) | (x["back"] > a["k"])
        size, shared = a["size"] + new.cast("int"), a["shared"] + (new & x["hit"]).cast("int")
        dice = lambda z: 2.0 * z["shared"] / (z["size"] + F.size(b))
        return held(
            F.struct(size.alias("size"), shared.alias("shared")),
            lambda z: F.struct((a["k"] + 1).alias("k"), z["size"].alias("size"), z["shared"].alias("shared"), F.greatest(a["dice"], dice(z)).alias("dice"), F.when(dice(z) > a["dice"], a["k"]).otherwise(a["end"]).alias("end")),
        )

    def at_starts(t: Column, g: Column) -> Column:
        """A template's windows, one at most for each place."""
        back = lambda x, i: F.array_position(F.reverse(F.slice(g, F.greatest(i - t["most"] + 1, F.lit(0)) + 1, F.least(i, t["most"] - 1))), x).cast("int")
        places = F.transform(g, lambda x, i: F.struct(F.array_contains(t["b"], x).alias("hit"), back(x, i).alias("back")))
        none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("size"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(0).alias("end"))

        def at(p: Column) -> Column:
            hits = F.filter(F.transform(p, lambda x, i: F.when(x["hit"], i)), lambda i: i.isNotNull())
            starts = held(hits, lambda h: F.filter(h, lambda i, k: F.get(h, k + t["need"] - 1) - i < t["most"]))
            best = lambda i: F.aggregate(F.slice(p, i + 1, t["most"]), none, lambda a, x: grown(a, x, t["b"]))
            found = F.transform(starts, lambda i: held(best(i), lambda w: F.struct(i.alias("start"), (-w["dice"]).alias("less"), (-t["at"]).alias("nth"), (i + w["end"]).alias("end"))))
            return F.filter(found, lambda w: w["less"] <= -least)

        return held(places, at)

    def counted(found: Column) -> Column:
        """Those that stay when of two that overlap the better does."""
        step = lambda a, w: (
            F.when(w["start"] > a["end"], F.struct((a["n"] + 1).alias("n"), w["less"].alias("less"), w["end"].alias("end")))
            .when(w["less"] < a["less"], F.struct(a["n"].alias("n"), w["less"].alias("less"), w["end"].alias("end")))
            .otherwise(a)
        )
        return F.aggregate(F.sort_array(found), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("less"), F.lit(-1).alias("end")), step, lambda a: a["n"])

    def told(found: Column, line: Column, whole: Column) -> Column:
        free = lambda w: ~F.exists(units, lambda u: (u["line"] >= whole) | (u["line"] >= F.get(line, w["start"])) & (u["line"] <= F.get(line, w["end"] + 1)))
        top = F.array_max(F.transform(found, lambda w: F.struct((-w["less"]).alias("dice"), F.lit(0).alias("own"), (-w["nth"]).alias("at"), F.lit(0).alias("line"))))
        return F.struct(counted(F.filter(found, free)).alias("n"), top.alias("top"))

    def tried(g: Column) -> Column:
        shared = F.array_intersect(g, known)
        hopeful = held(shared, lambda s: F.filter(templates, lambda t: F.size(F.array_intersect(t["b"], s)) >= t["need"]))
        line = F.flatten(F.transform(lines, lambda x, i: F.array_repeat(i, F.size(normal(x)))))
        return held(hopeful, lambda ts: F.when(F.size(ts) > 0, held(F.flatten(F.transform(ts, lambda t: at_starts(t, g))), lambda found: F.when(F.size(found) > 0, held(line, lambda of: held(F.size(lines), lambda whole: told(found, of, whole)))))))

    return held(normal(text), lambda w: held(neighbours(w), tried))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_DICE, given: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_matches, license, template, dice (of the best match, null without one).

    given: templates by licence; longer texts than those of TEMPLATES can be among them.

    Units are a text's lines and, if there are several, the whole text. Dice is twice the shared bigrams over both
    sides' bigrams, each bigram once; a unit matches a template from `least` on. Shared bigrams are at most the smaller
    side, so a template of b bigrams is only compared with units of b * least / (2 - least) to b * (2 - least) / least;
    and a unit without any of needed_words() matches nothing. Ties go to the earlier licence and template in TEMPLATES.
    A notice wrapped over lines, or inside a line, is a window of words (see windows()): it counts if it touches no unit
    that matches, and is the best match if its Dice is above that of all units.
    A null or empty text has no match. All is computed row by row: no shuffle, and repeated rows, ids or very long texts
    change nothing; an empty table gives an empty result.
    """
    templates = template_bigrams(given)
    low = min(len(b) for *_, b in templates) * least / (2 - least)
    high = max(len(b) for *_, b in templates) * (2 - least) / least
    words = needed_words(templates, least)

    def hopeful(lower: Column) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(lower, F.lit(w))
        return found

    def best(unit: Column) -> Column:
        size = F.size(unit)
        tries = []
        for i, (_, _, b) in enumerate(templates):
            fits = (size >= len(b) * least / (2 - least)) & (size <= len(b) * (2 - least) / least)
            dice = 2.0 * F.size(F.array_intersect(unit, F.array(*map(F.lit, b)))) / (size + len(b))
            tries.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(1).alias("own"), F.lit(-i).alias("at"))))
        return F.array_max(F.array(*tries))

    # steps by transform(): a lambda's variable is computed once, an expression as often as it stands there
    # a unit's line is its number, the whole text's is the number of lines
    lines = F.split(F.col(text), "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(F.col(text)))).otherwise(lines)
    numbered = F.transform(units, lambda x, i: F.struct(x.alias("x"), i.alias("line")))
    cut = F.transform(F.filter(numbered, lambda u: (F.octet_length(u["x"]) > 2 * low) & F.transform(F.array(F.lower(u["x"])), hopeful)[0]), lambda u: F.struct(normal(u["x"]).alias("x"), u["line"].alias("line")))
    pairs = F.filter(F.transform(F.filter(cut, lambda u: F.size(u["x"]) > low), lambda u: F.struct(bigrams(u["x"]).alias("x"), u["line"].alias("line"))), lambda u: (F.size(u["x"]) >= low) & (F.size(u["x"]) <= high))
    tops = F.transform(pairs, lambda u: held(best(u["x"]), lambda m: F.when(m["dice"] >= least, F.struct(m["dice"].alias("dice"), m["own"].alias("own"), m["at"].alias("at"), u["line"].alias("line")))))
    found = F.filter(tops, lambda x: x.isNotNull())
    both = lambda m, w: F.struct((F.size(m) + F.coalesce(w["n"], F.lit(0))).alias("n"), F.array_max(F.array(F.array_max(m), w["top"])).alias("top"))
    matched = held(found, lambda m: held(windows(F.col(text), lines, m, templates, least), lambda w: both(m, w)))
    lowered = docs.select(F.col(key).alias("doc_id"), F.col(text), F.lower(text).alias("_l"))
    # a generator: else the optimizer would put the whole expression wherever the result is read
    scored = lowered.select("doc_id", F.explode(F.array(F.when(hopeful(F.col("_l")), matched))).alias("_f"))
    there = F.coalesce(F.col("_f.n"), F.lit(0)) > 0
    pick = lambda values: F.when(there, F.element_at(F.array(*map(F.lit, values)), F.when(there, (1 - F.col("_f.top.at")).cast("int")).otherwise(1)))
    n = F.when(there, F.col("_f.n")).otherwise(0).cast("long")
    return scored.select("doc_id", n.alias("n_matches"), pick([n for n, *_ in templates]).alias("license"), pick([i for _, i, _ in templates]).alias("template"), F.when(there, F.round("_f.top.dice", 6)).alias("dice"))
