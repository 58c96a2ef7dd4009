"""Licence scan: a generalised suffix automaton of licence tokens, matching statistics and chains of long matches.

The automaton has every run of words of every template. A text's words are streamed through it; at each word the state
gives the longest run, ending there, that some template has (the matching statistics). Only stretches of words that occur
in templates are streamed: any other word resets the automaton. Matches of ``LONG`` words or more, where the statistics
stop growing, are chained per template as long as both the text and the template go forward and the gap in the text is
small. A chain covers template words; the share covered is the template's score. A template is reported from ``COVER`` of
its words on. The base phrases are found word by word beside that and always stay.

Scale: a map over whole texts; the automaton is a few thousand states, built in the driver from the templates. Memory is
that of one text's words.

Defined results: a null or empty text has no words and no labels; rows without an id are scanned as any others; repeated
rows get the same result; of equal matches the template's next place counts; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import alphanumeric_words

LONG, GAP, COVER = 4, 12, 0.6

# The phrases that are always reported, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices by which licences are recognised, and the paragraphs of the short ones' whole texts.
TEMPLATES = {
    "mit": [
        "released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "gpl-2": ["under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "agpl-3": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "cc0": ["has waived all copyright and related or neighboring rights to this work", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights"],
    "cc-by-nc": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "licensed under CC BY-SA 4.0"],
    "cc-by": ["licensed under a Creative Commons Attribution 4.0 International License"],
}


class Automaton:
    """Suffix automaton of several runs of symbols; each state knows where in which runs its strings end."""

    def __init__(self, runs: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, run in enumerate(runs):
            last = 0
            for place, symbol in enumerate(run):
                last = self._extend(last, symbol)
                self.ends[last].add((which, place + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.longest[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()
        self.by_run = [[(which, [p for _, p in places]) for which, places in groupby(sorted(e), key=itemgetter(0))] for e in self.ends]

    def _state(self, longest: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.longest.append(longest)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, longest: int) -> int:
        """A copy of the state after ``symbol`` for its strings of up to ``longest``."""
        old = self.next[state][symbol]
        new = self._state(longest, self.link[old], dict(self.next[old]))
        self.link[old] = new
        while state >= 0 and self.next[state].get(symbol) == old:
            self.next[state][symbol] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            there = self.next[last][symbol]
            return there if self.longest[there] == self.longest[last] + 1 else self._split(last, symbol, self.longest[last] + 1)
        new, state = self._state(self.longest[last] + 1, 0, {}), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][symbol]
            self.link[new] = there if self.longest[there] == self.longest[state] + 1 else self._split(state, symbol, self.longest[state] + 1)
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """At each symbol the length of the longest match that ends there, and its state."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            state = self.next[state].get(symbol, 0)
            length = length + 1 if state else 0
            yield length, state


class Scanner:
    """Templates and phrases as symbols, ready for texts."""

    def __init__(self, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> None:
        templates, phrases = templates or TEMPLATES, PHRASES if phrases is None else phrases
        self.symbols: dict[bytes, int] = {}
        self.runs, self.labels = [], []
        for label, texts in templates.items():
            for t in texts:
                self.runs.append(self._coded(t))
                self.labels.append(label)
        self.phrases = [(label, self._coded(p)) for p, label in phrases.items()]
        self.automaton = Automaton(self.runs)

    def _coded(self, text: str) -> list[int]:
        return [self.symbols.setdefault(w, len(self.symbols) + 1) for w in alphanumeric_words(text.encode())]

    def _matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(end in the text, length, state) of long matches that can't be extended to the right."""
        known = np.r_[False, codes > 0, False]
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a < LONG:
                continue
            before = (0, 0)
            for place, (length, state) in enumerate(self.automaton.statistics(codes[a:b].tolist())):
                if before[0] >= LONG and length <= before[0]:
                    yield a + place, *before
                before = (length, state)
            if before[0] >= LONG:
                yield b, *before

    def scan(self, text: bytes) -> dict:
        """Counts, labels, and the covered spans: (label, first word, end word, share of the template)."""
        words = alphanumeric_words(text)
        codes = np.fromiter(map(self.symbols.get, words, repeat(0)), np.int32, len(words))
        places: list[int] = []
        base: set[str] = set()
        for label, run in self.phrases:
            n = len(codes) - len(run) + 1
            if n > 0:
                found = np.flatnonzero(np.logical_and.reduce([codes[i : i + n] == s for i, s in enumerate(run)]))
                places += found.tolist()
                base |= {label} if len(found) else set()
        chains: dict[int, list[int]] = {}  # template: first word, end word, end in the template, words covered
        spans = []

        def close(which: int) -> None:
            first, end, _, covered = chains.pop(which)
            if covered >= COVER * len(self.runs[which]):
                spans.append((self.labels[which], first, end, covered / len(self.runs[which])))

        best = 0.0
        for end, length, state in self._matches(codes):
            end = int(end)
            for which, places_there in self.automaton.by_run[state]:
                c = chains.get(which)
                # where a string occurs several times in a template, the next place after the chain
                place = next((p for p in places_there if not c or p > c[2]), places_there[0])
                if c and (end - length > c[1] + GAP or place <= c[2]):
                    close(which)
                    c = None
                if c:
                    c[3] += min(length, end - c[1], place - c[2])
                    c[1], c[2] = end, place
                else:
                    c = chains[which] = [end - length, end, place, length]
                best = max(best, c[3] / len(self.runs[which]))
        for which in list(chains):
            close(which)
        return {"n_words": len(words), "places": places, "base": base, "spans": spans, "score": 1.0 if base else min(best, 1.0)}


def scan(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: words, base places and labels, all labels, score, and the covered spans in words."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scan(t.as_py() or b"") for t in batch.column(1)]
            yield pa.record_batch([
                batch.column(0),
                pa.array([f["n_words"] for f in found], pa.int64()),
                pa.array([len(f["places"]) for f in found], pa.int64()),
                pa.array([min(f["places"], default=None) for f in found], pa.int64()),
                pa.array([max(f["places"], default=None) for f in found], pa.int64()),
                pa.array([",".join(sorted(f["base"])) for f in found], pa.string()),
                pa.array([",".join(sorted(f["base"] | {s[0] for s in f["spans"]})) for f in found], pa.string()),
                pa.array([f["score"] for f in found], pa.float64()),
                pa.array([[{"label": a, "first": b, "end": c, "cover": d} for a, b, c, d in f["spans"]] for f in found], spans),
            ], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, end long, cover double>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(scanned, schema)
