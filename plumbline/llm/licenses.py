"""License scans: passages of a text compared with licence templates by Dice over word bigrams.

Text is normalised to its lower-case words.  A passage of a text runs from one
bigram that a template has to another; its Dice coefficient with the template
is 2 * common / (bigrams of the passage + bigrams of the template), bigrams
counted with multiplicity.  Licences quote each other and texts repeat their
notices, so all passages of all templates that reach the threshold t compete:
the best takes its place, one more than half of which is taken gives way, and a
licence is reported, with its best passage, only where it wins a place.

Sizes prune: a passage of m bigrams can reach t with a template of n only if
n t / (2 - t) <= m <= n (2 - t) / t, and at least n t / (2 - t) of the text's
bigrams must be the template's; most templates end there without a comparison.
Starts are looked at in blocks of a sixteenth of the template, under a bound from
the block's first start; blocks that others have taken are not looked into, so
the work grows in proportion to the text.

Nothing is shuffled; a task needs memory for one text at a time.

Defined cases: null texts, empty texts and texts of one word match nothing;
texts of any length are scanned whole; of passages with equal scores the
longest, then that of the first template, then the first counts; repeated rows are scanned each; templates of
fewer than two words never match; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pkgutil
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, steps

WORD = re.compile(r"\w+")
THRESHOLD = 0.8

ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
    "to the following conditions:")
MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: Licences whose full texts are in ``license_texts``.
BODIES = ["Apache-2.0", "MPL-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
#: Notices and licence texts as their authors publish them; the AGPL-3.0 body alone is put together here
#: from the GPL-3.0 text and the AGPL's own preamble and section 13, so that its copies are not taken for the GPL-3.0.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
                   "the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
            "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                "any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
                "any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *[(name, f"This work is licensed under the GNU {kind} General Public License, version {version}.")
      for name, kind, version in (("GPL-2.0", "", "2"), ("AGPL-3.0", "Affero", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"))],
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                 "any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
                 "any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                 "any later version."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
                "this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
                "Public License v1.0 which accompanies this distribution, and is available at "
                "http://www.eclipse.org/legal/epl-v10.html"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
             "but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
             "the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
             + ISC_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. " + ISC_WARRANTY),
    ("MIT", MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software. " + MIT_WARRANTY),
    ("MIT-0", MIT_GRANT.rsplit(",", 1)[0] + ". " + MIT_WARRANTY),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: 1. " + BSD_CLAUSES + BSD_WARRANTY),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: 1. " + BSD_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may "
            "be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_WARRANTY),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
                  "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
                  "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to "
                  "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
                  + MIT_WARRANTY.split(" SHALL THE AUTHORS")[0] + " SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
                  "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
                  "OR OTHER DEALINGS IN THE SOFTWARE."),
    *[(name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in BODIES],
]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """The templates' bigrams, and the search for their best passages."""

    def __init__(self, templates, threshold: float):
        self.threshold, self.templates, self.owners = threshold, [], {}
        for name, text in templates:
            found = words(text)
            bigrams = Counter(zip(found, found[1:]))
            for bigram in bigrams:
                self.owners.setdefault(bigram, []).append(len(self.templates))
            size = sum(bigrams.values())
            low, high = size * threshold / (2 - threshold), size * (2 - threshold) / threshold
            self.templates.append((name, bigrams, size, low, high))

    def hits(self, text: str) -> dict[int, list]:
        """For every template the places of the text's bigrams that it has."""
        found = words(text)
        hits: dict[int, list] = {}
        owners = self.owners
        for at, bigram in enumerate(zip(found, found[1:])):
            if bigram in owners:
                for number in owners[bigram]:
                    hits.setdefault(number, []).append((at, bigram))
        return hits

    def scan(self, text: str):
        """(template number, score, first bigram, last bigram) of every template that the text holds."""
        hits = self.hits(text)
        for number in sorted(hits):
            best = self.best(number, hits[number])
            if best:
                yield number, *best

    def licenses(self, text: str) -> list[tuple]:
        """(template number, score, first bigram, last bigram) of every licence that wins a place, of its passages the best.

        All passages of all templates compete: the best takes its place, and a
        passage more than half of which is taken is out.  Blocks of starts
        stand in the queue under a bound until they have to be looked into.
        """
        hits = self.hits(text)
        searches = {n: Passages(self.templates[n], self.threshold, hits[n]) for n in hits if len(hits[n]) >= self.templates[n][3] > 0}
        # (-score, -length, template, start): with a score of 1 a passage is as long as its template
        queue = [(-bound, -search.size if bound == 1 else -search.high, number, int(search.places[search.blocks[block][0]]), 0, block)
                 for number, search in searches.items() for block, bound in search.bounds()]
        if not queue:
            return []
        heapq.heapify(queue)
        taken = np.zeros(1 + max(h[-1][0] for h in hits.values()), bool)
        named: dict[str, tuple] = {}
        while queue:
            bound, length, number, first, known, block = heapq.heappop(queue)
            search = searches[number]
            if known:
                place = slice(first, first - length)
                if 2 * int(taken[place].sum()) <= -length:
                    named.setdefault(search.name, (number, -bound, first, first - length - 1))
                    taken[place] = True
            if search.lost(block, taken):
                continue
            found = search.best_of(block, taken)
            if found:
                score, first, last = found
                heapq.heappush(queue, (-score, first - last - 1, number, first, 1, block))
        return sorted(named.values())

    def best(self, number: int, hits: list):
        _, bigrams, size, low, high = self.templates[number]
        if not len(hits) >= low > 0:
            return None
        places, before = positions(bigrams, hits)
        ends = np.searchsorted(places, places + high, "left")  # a passage of at most ``high`` bigrams
        top = None
        for i in np.flatnonzero(ends - np.arange(len(hits)) >= low - 1e-9).tolist():
            lengths = places[i:ends[i]] - places[i] + 1
            scores = 2 * np.cumsum(before[i:ends[i]] < i) / (lengths + size)
            scores[(lengths < low) | (lengths > high)] = 0
            j = int(scores.argmax())
            if scores[j] >= self.threshold and (top is None or scores[j] > top[0]):
                top = (float(scores[j]), int(places[i]), int(places[i + j]))
        return top


class Passages:
    """The passages of one template in one text, in blocks of neighbouring starts."""

    def __init__(self, template, threshold: float, hits: list):
        self.name, bigrams, self.size, self.low, self.high = template
        self.threshold = threshold
        self.places, self.before = positions(bigrams, hits)
        ends = np.searchsorted(self.places, self.places + self.high, "left")
        enough = ends - np.arange(len(hits)) >= self.low - 1e-9
        block = self.places // max(1, int(self.size / 16))
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        self.blocks = [(a, b) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hits)]) if enough[a:b].any()]

    def scores(self, i: int, high: float):
        """Lengths and scores of the passages from hit ``i`` to those within ``high`` bigrams; too short ones score 0."""
        end = int(np.searchsorted(self.places, self.places[i] + high, "left"))
        lengths = self.places[i:end] - self.places[i] + 1
        scores = 2 * np.cumsum(self.before[i:end] < i) / (lengths + self.size)
        scores[(lengths < self.low) | (lengths > high)] = 0
        return lengths, scores

    def bounds(self):
        """(block, bound of its scores) where the bound reaches the threshold.

        A passage that starts d bigrams after the first start of the block is
        part of one from there with no fewer hits, which is d longer.
        """
        for number, (a, b) in enumerate(self.blocks):
            d = int(self.places[b - 1] - self.places[a])
            scores = self.scores(a, self.high + d)[1]
            bound = min(1.0, float(scores.max()) * (1 + d / (self.low + self.size)) + 1e-9)
            if bound >= self.threshold:
                yield number, bound

    def lost(self, block: int, taken) -> bool:
        """Whether more than half of every passage from the block is taken."""
        a, b = self.blocks[block]
        start, d = int(self.places[a]), int(self.places[b - 1] - self.places[a])
        free = np.cumsum(~taken[start:start + d + int(self.high)])
        lengths = np.arange(math.ceil(self.low - 1e-9), int(self.high) + 1)
        return bool((2 * free[np.minimum(d + lengths, len(free)) - 1] < lengths).all())

    def best_of(self, block: int, taken):
        """(score, first, last) of the block's best passage at most half of which is taken."""
        a, b = self.blocks[block]
        top = None
        for i in range(a, b):
            lengths, scores = self.scores(i, self.high)
            start = int(self.places[i])
            used = taken[start:start + int(lengths[-1])]
            if used.any():
                scores[2 * np.cumsum(used)[lengths - 1] > lengths] = 0
            j = len(scores) - 1 - int(scores[::-1].argmax())
            if scores[j] >= self.threshold and (top is None or (scores[j], lengths[j]) > (top[0], top[2] - top[1] + 1)):
                top = (float(scores[j]), start, start + int(lengths[j]) - 1)
        return top


def positions(bigrams: Counter, hits: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hits, and for each the index of the hit that a passage must not reach back to for it to count:
    a hit counts in a passage unless as many like it as the template has stand before it there."""
    seen: dict[tuple, list] = {}
    before = np.full(len(hits), -1)
    for i, (_, bigram) in enumerate(hits):
        like = seen.setdefault(bigram, [])
        like.append(i)
        if len(like) > bigrams[bigram]:
            before[i] = like[-1 - bigrams[bigram]]
    return np.array([at for at, _ in hits]), before


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, template, score, and the place of the passage: first and last character, and words."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("score", pa.float64()),
                        ("first_char", pa.int64()), ("end_char", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        scanner = Scanner(templates, threshold)
        for batch in steps(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = text.as_py() or ""
                found = scanner.licenses(body)
                places = [m.span() for m in WORD.finditer(body)] if found else []
                exact = len(places) == len(words(body)) if found else True  # lower-casing may add characters that split words
                for number, score, first, last in found:
                    rows.append((key, scanner.templates[number][0], number, score, places[first][0] if exact else None,
                                 places[last + 1][1] if exact else None, last - first + 2))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, license string, template int, score double, first_char long, end_char long, n_words long")
