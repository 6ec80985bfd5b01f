"""License scans by a positional rare-token index, with DataFrame functions only.

The index is over templates: names of licences, passages, and whole texts and notices. A licence word's IDF is
taken over them, and each template has postings (template, position) under the words of highest IDF of its
key phrase. A file looks up its words that have postings; each posting says where in the file its template
would begin. These places are intersected: a template stays where all its postings say the same begin. There
its key phrase is verified word for word, and all its words are compared with the file's at the same
relative positions; what agrees is weighed by IDF, and the template is found where that is enough. Of whole
texts the key phrase is a small part, so agreement decides; names are found by their key phrase alone.

As a key phrase must stand in full, all its postings agree where it does, so the intersection loses none.
Everything happens within a row; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .common import words as plain_words


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: Must stand word for word; part of `words`.
    key: str
    base: bool = False


#: The base phrases and labels, then passages of licence texts with labels of their own.
NAMES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-header", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "not use this file except in compliance with the license"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    Template("cc0", "creative commons cc0 1 0 universal", "cc0 1 0"),
    Template("cc-by", "licensed under cc by", "cc by"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


def _whole(label: str, key: str, text: str) -> Template:
    return Template(label, " ".join(plain_words(text)), key)


#: Whole licence texts and notices, without their titles, names and years.
WHOLE = (
    _whole(
        "mit-whole",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    _whole(
        "bsd-2-whole",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    _whole(
        "isc-whole",
        "provided that the above copyright notice and this permission notice appear in all copies",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    _whole(
        "apache-notice",
        "you may not use this file except in compliance with the license",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    _whole(
        "gpl-notice",
        "you can redistribute it and or modify it under the terms of the gnu general public license",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    _whole(
        "mpl-notice",
        "source code form is subject to the terms of the mozilla public license",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    _whole(
        "unlicense-whole",
        "this is free and unencumbered software released into the public domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    ),
    _whole(
        "zlib-whole",
        "the origin of this software must not be misrepresented",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    ),
)
TEMPLATES = NAMES + WHOLE


def _key_at(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def rarest(templates: tuple[Template, ...], most: int = 4) -> tuple[dict[str, float], dict[str, list[tuple[int, int]]]]:
    """IDF of every licence word over the templates, and the postings of the rare ones.

    Each template is posted under the `most` different words of highest IDF in its key phrase, the longer
    ones first among equals, at each of their places there.
    """
    split = [t.words.split() for t in templates]
    df = Counter(w for words in split for w in set(words))
    idf = {w: math.log(1 + len(templates) / n) for w, n in df.items()}
    index: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        key = t.key.split()
        at = _key_at(split[k], key)
        own = set(sorted(set(key), key=lambda w: (-idf[w], -len(w), w))[:most])
        for p, word in enumerate(key):
            if word in own:
                index.setdefault(word, []).append((k, at + p))
    return idf, index


def _sql(templates: tuple[Template, ...], idf: dict[str, float]) -> str:
    """The templates as an array of structs."""
    rows = []
    for t in templates:
        words, key = t.words.split(), t.key.split()
        at = _key_at(words, key)
        total = sum(idf[w] for w in words)
        array = lambda x: f"array({', '.join(repr(w) for w in x)})"
        rows.append(f"named_struct('label', '{t.label}', 'words', {array(words)}, 'weights', array({', '.join(f'{idf[w] / total:.6f}D' for w in words)}), 'key', {array(key)}, 'key_at', {at}, 'base', {str(t.base).lower()})")
    return f"array({', '.join(rows)})"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = 0.5) -> DataFrame:
    """The columns of `docs` with n_words and found: (label, start, score, base) of every place of a template.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; starts count words
    from 0. A null or empty text has no words. Rows stand alone: repeated rows find the same, places of
    equal templates are ordered by start, then label; an empty table gives an empty one. Older columns of
    these names are replaced.
    """
    idf, index = rarest(templates)
    postings = "map(" + ", ".join(f"{w!r}, array({', '.join(f'named_struct({"'t'"}, {t}, {"'p'"}, {p})' for t, p in places)})" for w, places in index.items()) + ")"
    kept = [docs[c] for c in docs.columns if c not in ("n_words", "found")]
    # lower() also maps the Kelvin sign to k; it must stay what it is, a character beyond ASCII
    low = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("K"), F.lit("ĸ")))
    frame = docs.select(*kept, F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("__w"))
    rare = ", ".join(map(repr, index))
    hits = F.expr(f"filter(transform(__w, (w, i) -> if(w in ({rare}), i, -1)), i -> i >= 0)")
    frame = frame.select("*", hits.alias("__hits"))
    # each posting's template and begin in one number; where one is there as often as its template has postings, all agree
    need = Counter(t for places in index.values() for t, _ in places)
    needs = f"array({', '.join(str(need[t]) for t in range(len(templates)))})"
    said = f"array_sort(flatten(transform(__hits, i -> transform(element_at({postings}, __w[i]), x -> shiftleft(cast(x.t as bigint), 40) + i - x.p + {1 << 20}))))"
    agreed = f"filter(sequence(0, size(s) - 1), k -> get(s, k + element_at({needs}, cast(shiftright(s[k], 40) as int) + 1) - 1) = s[k] and (k = 0 or s[greatest(k - 1, 0)] <> s[k]))"
    begins = F.expr(f"transform(array({said}), s -> transform({agreed}, k -> named_struct('t', cast(shiftright(s[k], 40) as int), 'at', cast((s[k] & {(1 << 40) - 1}) - {1 << 20} as int))))[0]")
    frame = frame.select("*", F.when(F.size("__hits") > 0, begins).alias("__begins"))
    at = f"transform(__begins, b -> named_struct('at', b.at, 'x', {_sql(templates, idf)}[b.t]))"
    key = "c.at + c.x.key_at >= 0 and slice(__w, greatest(c.at + c.x.key_at, 0) + 1, size(c.x.key)) = c.x.key"
    score = "aggregate(sequence(0, size(c.x.words) - 1), 0D, (sum, j) -> sum + if(c.at + j >= 0 and get(__w, c.at + j) = c.x.words[j], c.x.weights[j], 0D))"
    found = F.expr(f"filter(transform(filter({at}, c -> {key}), c -> named_struct('start', cast(c.at + c.x.key_at * int(not c.x.base) as bigint), 'label', c.x.label, 'score', round({score}, 6), 'base', c.x.base)), f -> f.score >= {least}D)")
    none = F.array().cast("array<struct<start: bigint, label: string, score: double, base: boolean>>")
    return frame.select(*[F.col(c) for c in docs.columns if c not in ("n_words", "found")], F.size("__w").cast("bigint").alias("n_words"), F.coalesce(F.array_sort(found), none).alias("found"))


def digests(scanned: DataFrame) -> DataFrame:
    base = F.filter("found", lambda x: x["base"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda f: f["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.least(F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
