"""Licence scan with a generalised suffix automaton (operator 8).

The automaton holds every word sequence of all templates.  A file's words stream
through it; the state and match length after each word are the matching statistics.
Matches of ``MIN_MATCH`` words or more that the next word doesn't extend are located
at every place of each template that has them, and matches that follow one another in
the file and in the template are chained: each takes the earlier one, at most ``GAP``
words back, whose chain covers most.  A template is found wherever a chain covers
``COVERED`` of it, or all of it if it has fewer than ``SHORT`` words, as a grant differs
from that of another version in a word or two.  A licence that stands twice is found
twice.

Four phrases are counted beside that (the base), each wherever its words stand
consecutively.

A-Z is lower-cased; words are runs of letters, digits and non-ASCII characters.  Null
texts are empty.  Repeated rows are scanned each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows, slices, strings

#: The phrases of the base and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Standard notices and usual grants of public licences.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "mit-grant": "released under the MIT License",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0-grant": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/""",
    "gpl-3.0-grant": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0-grant": "This work is licensed under the GNU General Public License, version 2",
    "cc-by-nc-4.0-grant": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-grant": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-grant": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0-notice": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
    "bsd-3-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "lgpl-2.1-grant": "licensed under the GNU Lesser General Public License, version 2.1",
    "lgpl-3.0-grant": "licensed under the GNU Lesser General Public License, version 3",
    "agpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. See the GNU Affero General Public License for more details.""",
    "agpl-3.0-grant": "licensed under the GNU Affero General Public License, version 3",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.""",
    "gfdl-1.3-notice": """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.""",
    "epl-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "epl-1.0-notice": """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
    "cddl-1.0-notice": """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.""",
    "eupl-1.2-notice": """Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.""",
    "mpl-1.1-notice": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/""",
    "cc0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "postgresql-text": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.""",
    "ofl-1.1-notice": """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at""",
    "odbl-1.0-notice": """This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/. Any rights in individual contents of the database are licensed under the Database Contents License""",
    "artistic-2.0-notice": """This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0. For details, see the full text of the license in the file LICENSE.""",
    "wtfpl-2-notice": """This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.""",
    "bsd-2-clause-grant": "Licensed under the BSD 2-Clause License",
    "bsd-3-clause-grant": "Licensed under the BSD 3-Clause License",
    "mpl-2.0-grant": "Licensed under the Mozilla Public License 2.0",
    "epl-2.0-grant": "Licensed under the Eclipse Public License 2.0",
    "cc0-1.0-grant": "Licensed under CC0 1.0",
    "cc-by-nc-sa-4.0-grant": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nd-4.0-grant": "Licensed under CC BY-ND 4.0",
    "cc-by-sa-4.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
}
MIN_MATCH = 3
COVERED = 0.75
SHORT = 20
#: Words of the file that may lie between two matches of a chain.
GAP = 12
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences; each state knows where its words end in each template."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._add(last, w)
                self.ends[last].setdefault(k, set()).add(at + 1)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for k, at in self.ends[s].items():
                self.ends[self.link[s]].setdefault(k, set()).update(at)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A state for the words of p with w, taken out of q."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the matches that cannot be extended to the right."""
        state = size = 0
        for at, w in enumerate(words):
            if size >= least and w not in self.next[state]:
                yield at, size, state
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
        if size >= least:
            yield len(words), size, state


class Chains:
    """Chains of matches with one template; matches come in the order of their ends in the file."""

    def __init__(self, least: float):
        self.least = least
        self.open: list[tuple[int, int, int, int]] = []  # file start, file end, template end, words covered
        self.full: list[tuple[int, int, int]] = []

    def add(self, a: int, b: int, places: list[tuple[int, int]]) -> None:
        """A match at words a to b of the file and at ``places`` of the template."""
        # starts never fall, so what is out of reach now stays so
        self.open = [c for c in self.open if a - c[1] <= GAP]
        new = []
        for s, e in places:
            first, covered = a, e - s
            for c_first, c_b, c_e, c_covered in self.open:
                if e > c_e and b > c_b:
                    more = c_covered + e - s - max(0, c_e - s, c_b - a)  # words already covered count once
                    if more > covered:
                        first, covered = c_first, more
            new.append((first, b, e, covered))
            if covered >= self.least:
                self.full.append((first, b, covered))
        self.open += new

    def found(self) -> list[tuple[int, int, int]]:
        """The fullest of the chains that overlap in the file: start, end, words covered."""
        out, reach = [], 0
        for c in sorted(self.full):
            if out and c[0] < reach:
                out[-1] = max(out[-1], c, key=lambda x: (x[2], -x[0], -x[1]))
            else:
                out.append(c)
            reach = max(reach, c[1])
        return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = list(templates)
        sequences = [words_of(t.encode()) for t in templates.values()]
        self.ids: dict[bytes, int] = {}
        for w in [w for s in sequences for w in s] + [w for p in phrases for w in words_of(p.encode())]:
            self.ids.setdefault(w, len(self.ids))
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton([[self.ids[w] for w in s] for s in sequences])
        self.phrases = [([self.ids[w] for w in words_of(p.encode())], label) for p, label in phrases.items()]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, float, int, int]]]:
        """(words, base places, found templates with share covered and word span)."""
        words = words_of(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        base = []
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0])
            for k in range(1, len(phrase)):
                at = at[ids[at + k] == phrase[k]]
            base += [(p, label) for p in at.tolist()]
        # a match has known words only, so runs of those are enough
        known = np.flatnonzero(ids >= 0)
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        edges = np.concatenate([[0], cut, [len(known)]]) if len(known) else np.zeros(1, np.int64)
        chains = [Chains(n if n < SHORT else COVERED * n) for n in self.sizes]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a < MIN_MATCH:
                continue
            start = int(known[a])
            for end, size, state in self.automaton.matches(ids[start : start + b - a].tolist(), MIN_MATCH):
                for k, stops in self.automaton.ends[state].items():
                    chains[k].add(start + end - size, start + end, [(stop - size, stop) for stop in stops])
        found = [(label, covered / size, first, last) for label, size, c in zip(self.labels, self.sizes, chains) for first, last, covered in c.found()]
        return len(words), base, found


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
        for batch in slices(batches, "t"):
            rows = []
            for text in strings(batch.column("t")):
                n, base, found = scanner.scan(text)
                places, labels = [p for p, _ in base], {x for _, x in base}
                spans = [{"label": x, "start": a, "end": b, "covered": c} for x, c, a, b in found]
                score = max([c for _, c, _, _ in found] + [1.0 if base else 0.0])
                rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, *_ in found})), score, spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("t"))
    return few_rows(rows).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>")
