"""License scans: normalised text against licence templates by Dice over word bigrams.

The segments of a text are its lines and its paragraphs of several lines. A segment and a template
of sizes s and t (distinct word bigrams) can reach a Dice coefficient d only if
``2 * min(s, t) >= d * (s + t)``; word counts outside the range that this leaves for
any template end the work on a segment before its bigrams are made, and sizes outside one
template's range skip that template. All steps are SQL functions on each row's own arrays: no join,
no shuffle, no Python.

Notices inside longer lines, paragraphs or comment blocks are found by windows of each template's
own length at every word offset of the text, against the templates and the whole notices and licence
texts of :data:`WHOLE`. A window can reach the threshold only if the text holds enough of the template's
bigrams, so templates of which it holds too few are left before any window is made.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Short notices and grants of common licences, by identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

#: Whole notices and texts of the same licences, for windows only. A long licence stands by the notice that its own
#: text ends with, or (CC0, LGPL) by its opening.
WHOLE: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: - Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. - Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. - The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "CC0-1.0": (
        'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").',
    ),
    "GPL-2.0": (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    ),
    "GPL-3.0": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "LGPL-3.0": (
        'This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.',
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/',
    ),
    "Unlicense": (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct word bigrams) of every template of two words or more."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in texts:
            w = _words(text)
            if len(w) > 1:
                out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return out


def size_range(size: int, threshold: float) -> tuple[int, int]:
    """Bigram counts of segments that can reach the threshold against ``size`` bigrams."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _segment_words(segment: Column) -> Column:
    """Lower-cased ASCII letters and digits, everything else as one space."""
    return F.split(F.trim(F.regexp_replace(F.translate(segment, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_HIT = "array<struct<start:int,low:double,shorter:int,license:string,segment:string>>"


def _windows(text: Column, found: Column, threshold: float, templates: list[tuple[str, str]]) -> Column:
    """Windows at the threshold, the best of those that overlap; none that the matched segments ``found`` already stand for."""
    known = []
    for name, notice in templates:
        w = _words(notice)
        own = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        if own:
            known.append((name, w, own, size_range(len(own), threshold)[0]))
    if not known:
        return F.array().cast(_HIT)
    every = F.array(*map(F.lit, sorted({p for _, _, own, _ in known for p in own})))

    def hits(pairs: Column, held: Column) -> Column:
        """Windows at the threshold; ``held`` is what the text has of all templates' bigrams."""
        tries = []
        for name, w, own, need in known:
            n, lit = len(w) - 1, F.array(*map(F.lit, own))

            def at(i: Column) -> Column:  # used within this turn of the loop only
                part = F.slice(pairs, i, n)
                dice = F.round(F.size(F.array_intersect(part, lit)) * 2.0 / (F.size(F.array_distinct(part)) + len(own)), 9)
                return F.struct(i.alias("start"), (-dice).alias("low"), F.lit(-n).alias("shorter"), F.lit(name).alias("license"), F.lit(None).cast("string").alias("segment"))

            offsets = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pairs) - n + 1))
            enough = (F.size(held) >= need) & (F.size(F.array_intersect(held, lit)) >= need)
            tries.append(F.when(enough, F.filter(F.transform(offsets, at), lambda h: h["low"] <= -threshold)).otherwise(F.array().cast(_HIT)))
        return F.array_sort(F.flatten(F.array(*tries)))

    def flags() -> Column:
        """For every word of the text, the best Dice of the matched line or paragraph it lies in, 0 outside."""
        same = F.array_distinct(F.transform(found, lambda m: F.struct(m["segment"].alias("segment"), m["dice"].alias("dice"))))
        blocks = F.split(text, "\n[ \\t\\r]*\n")

        def of_line(b: Column, s: Column) -> Column:
            own = F.filter(same, lambda m: (m["segment"] == b) | (m["segment"] == s))
            dice = F.coalesce(F.array_max(F.transform(own, lambda m: m["dice"])), F.lit(0.0))
            return F.array_repeat(dice, F.size(F.filter(_segment_words(s), lambda w: w != "")))

        return F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(F.split(b, "\n"), lambda s: of_line(b, s)))))

    def last(h: Column) -> Column:
        return h["start"] - h["shorter"]

    def fresh(picked: Column) -> Column:
        """Without windows that lie in matched segments, or touch one of no lower Dice."""
        part = lambda f, h: F.slice(f, h["start"], 1 - h["shorter"])
        outside = lambda f: F.filter(picked, lambda h: F.exists(part(f, h), lambda x: x == 0.0) & ~F.exists(part(f, h), lambda x: x >= -h["low"]))
        return F.when((F.size(found) == 0) | (F.size(picked) == 0), picked).otherwise(_let(flags(), outside))

    def sweep(kept: Column, h: Column) -> Column:
        end = F.try_element_at(kept, F.lit(-1))
        better = (h["low"] < end["low"]) | ((h["low"] == end["low"]) & (h["shorter"] < end["shorter"]))
        added = F.concat(kept, F.array(h))
        overlaps = (F.size(kept) > 0) & (h["start"] <= last(end))
        return F.when(overlaps & better, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(h))).when(overlaps, kept).otherwise(added)

    def named(words: Column, picked: Column) -> Column:
        return F.transform(picked, lambda h: F.struct(h["license"].alias("license"), (-h["low"]).alias("dice"), F.array_join(F.slice(words, h["start"], 1 - h["shorter"]), " ").alias("segment")))

    def of_words(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        picked = _let(_let(pairs, lambda p: _let(F.array_intersect(p, every), lambda held: hits(p, held))), lambda h: _let(F.aggregate(h, F.array().cast(_HIT), sweep), fresh))
        return F.when(F.size(words) > 1, named(words, picked))

    worded = _let(F.filter(_segment_words(text), lambda w: w != ""), of_words)
    return F.coalesce(worded, F.array().cast("array<struct<license:string,dice:double,segment:string>>"))


def license_matches(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] = TEMPLATES, whole: dict[str, tuple[str, ...]] = WHOLE) -> DataFrame:
    """Append ``licenses`` (array of struct license, dice, segment) and ``license``, ``dice`` of the best, to every row.

    Each segment names its best template: the highest Dice, then the first licence by name.
    ``licenses`` is in the order of lines, then paragraphs, then windows of the text's words (their segment
    is the lower-cased words). Of overlapping windows the best stays, unless a matched line or paragraph
    covers it or one that it touches has no lower Dice. ``license`` is null and ``dice`` 0 where nothing reaches the threshold, so for null and
    empty texts too. Columns of those names are replaced.
    """
    bigrams = template_bigrams(templates)
    ranges = [size_range(len(b), threshold) for _, b in bigrams]
    # With w words of which v differ, distinct bigrams are at most w - 1 and at least v - 1.
    least = min((lo for lo, _ in ranges), default=1) + 1
    most = max((hi for _, hi in ranges), default=0)
    kept = docs.drop("licenses", "license", "dice")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    blocks = F.filter(F.split(text, "\n[ \\t\\r]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    segments = F.concat(lines, blocks)
    worded = F.transform(segments, lambda s: F.struct(s.alias("segment"), _segment_words(s).alias("words")))
    worded = F.filter(worded, lambda s: (F.size(s["words"]) >= least) & (F.size(F.array_distinct(s["words"])) <= most + 1))
    sized = F.transform(worded, lambda s: F.struct(s["segment"].alias("segment"), _bigrams(s["words"]).alias("bigrams")))
    sized = F.filter(sized, lambda s: F.size(s["bigrams"]).between(least - 1, most))

    def best(s: Column) -> Column:
        tries = []
        for (name, own), (lo, hi) in zip(bigrams, ranges, strict=True):
            size = F.size(s["bigrams"])
            dice = F.size(F.array_intersect(s["bigrams"], F.array(*map(F.lit, own)))) * 2.0 / (size + len(own))
            tries.append(F.when(size.between(lo, hi), F.struct((-F.round(dice, 9)).alias("low"), F.lit(name).alias("license"))))
        top = F.array_min(F.array_compact(F.array(*tries)))
        return F.struct(top["license"].alias("license"), (-top["low"]).alias("dice"), s["segment"].alias("segment"))

    found = F.filter(F.transform(sized, best), lambda m: F.coalesce(m["dice"] >= threshold, F.lit(False)))
    notices = [(name, t) for group in (templates, whole) for name, texts in sorted(group.items()) for t in texts]
    out = kept.withColumn("licenses", found)
    out = out.withColumn("licenses", F.concat("licenses", _windows(text, F.col("licenses"), threshold, notices)))
    winner = F.array_min(F.transform("licenses", lambda m: F.struct((-m["dice"]).alias("low"), m["license"].alias("license"))))
    return out.withColumn("_winner", winner).select(*kept.columns, "licenses", F.col("_winner.license").alias("license"), F.coalesce(-F.col("_winner.low"), F.lit(0.0)).alias("dice"))


def license_sql(threshold: float = THRESHOLD) -> str:
    """The registered query in DuckDB's SQL: ``doc_id, n_matches, license, dice``."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(b) for b in own)}])" for name, own in template_bigrams())
    return f"""
        WITH template(license, own) AS (VALUES {rows}),
        segment AS (
            SELECT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)),
                list_filter(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), lambda p: contains(trim(p, ' '), chr(10))))) AS s
            FROM documents
        ), worded AS (
            SELECT doc_id, row_number() OVER () AS k, string_split(trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM segment
        ), paired AS (
            SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
            FROM worded WHERE len(w) >= 2
        ), scored AS (
            SELECT doc_id, k, license, round(2.0 * len(list_intersect(b, own)) / (len(b) + len(own)), 9) AS dice
            FROM paired, template WHERE 2.0 * least(len(b), len(own)) >= {threshold} * (len(b) + len(own)) - 1e-6
        ), best AS (
            SELECT doc_id, k, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM scored WHERE dice >= {threshold} GROUP BY doc_id, k
        ), named AS (
            SELECT doc_id, count(*) AS n_matches, arg_min(license, (-dice, license)) AS license, max(dice) AS dice FROM best GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n.n_matches, 0)::BIGINT AS n_matches, n.license, coalesce(n.dice, 0.0)::DOUBLE AS dice
        FROM documents d LEFT JOIN named n USING (doc_id)
    """
