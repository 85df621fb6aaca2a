"""Licence scan: a generalised suffix automaton over the words of licence templates gives matching statistics.

The automaton holds every word sequence that occurs in a template. A text is streamed through it once: at each word it
yields the length of the longest sequence ending there that some template contains, and the automaton state. Phrases
of the base list are read off the states (a phrase ends where the statistics reach its length in a state below it).
The statistics of a single template are those of the nearest state up the suffix links that it holds; they are kept per
state, so each template's matches end where its own statistics do, whatever other templates go on to match. Matches of at
least ``LONG`` words (or a whole shorter template), at every place where the template holds them, are chained per template: the chain that covers most words, in text order and with template positions that advance,
over gaps of at most ``GAP`` words. A chain that covers ``COVER`` of the template is a span and gives the template's label.

Templates are a parameter, (label, text) pairs; ``templates()`` reads them from a table, ``folder_templates()`` from files.
The default ones are notices and whole short licences.

Words outside all templates reset the stream, so only runs of known words are walked. The automaton is built from
constants and its size does not depend on the corpus.

Defined cases: null text is empty (no words, no places, no labels, score 0); equal texts have equal rows; of chains that
cover as much the one that starts first counts; texts of any length are taken whole; null or repeated ids are returned as
they are; columns but doc_id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LONG, GAP, COVER = 5, 6, 0.6

#: Phrases that are counted wherever they stand, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Standard public wordings (notices and opening passages) with the label of each.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
        whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this
        entire statement, including the above license grant, this restriction and the following disclaimer, must be included
        in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
        derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law."""),
)

_KEEP = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_WORDS = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; maximal runs of digits, letters a-z and bytes of other than ASCII characters."""
    return text.translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences (numbers)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.at: list[dict[int, list[int]]] = [{}]  # template -> end positions of the state's sequences there
        for t, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.at[last].setdefault(t, []).append(i)
        whole = {len(x) for x in sequences}
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for t, i in self.at[s].items():
                up = self.at[self.link[s]]
                up[t] = sorted({*up.get(t, ()), *i})
        for s in range(1, len(self.link)):  # no match is as short as these states' sequences
            if self.length[s] < LONG and not any(self.length[self.link[s]] < n <= self.length[s] for n in whole):
                self.at[s] = {}

    def _new(self, length: int, copy: int = -1) -> int:
        self.next.append(dict(self.next[copy]) if copy >= 0 else {})
        self.link.append(self.link[copy] if copy >= 0 else 0)
        self.length.append(length)
        self.at.append({})
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state reached from p by w whose longest sequence is p's and w; cloned off a longer one if need be."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._new(self.length[p] + 1, q)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = self._split(p, w) if p >= 0 else 0
        return new


@dataclass(frozen=True)
class Span:
    label: str
    start: int
    end: int  # words, from 0, end excluded
    cover: float


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [lab for _, lab in base] + [lab for lab, _ in templates]
        texts = [words(p.encode()) for p, _ in base] + [words(t.encode()) for _, t in templates]
        self.vocabulary: dict[bytes, int] = {}
        seqs = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for t in texts]
        self.auto = Automaton(seqs)
        self.size = [len(s) for s in seqs]
        self.base = len(base)
        # phrases that end in a state: (length, phrase) for the state and all that its suffix links lead to
        ends: list[list[tuple[int, int]]] = [[] for _ in self.auto.link]
        for k, s in enumerate(seqs[: self.base]):
            state = 0
            for w in s:
                state = self.auto.next[state][w]
            ends[state].append((len(s), k))
        for s in sorted(range(1, len(ends)), key=lambda s: self.auto.length[s]):
            ends[s] += ends[self.auto.link[s]]
        self.ends = ends
        # what a state says of templates that only shorter sequences of it lie in: template -> (length, state)
        self.above: list[dict[int, tuple[int, int]]] = [{} for _ in self.auto.link]
        for s in sorted(range(1, len(ends)), key=lambda s: self.auto.length[s]):
            up = self.auto.link[s]
            near = {t: (self.auto.length[up], up) for t in self.auto.at[up] if self._counts(t, self.auto.length[up])}
            self.above[s] = {t: v for t, v in (self.above[up] | near).items() if t not in self.auto.at[s]}
        self.shortest = min((n for n in self.size if n), default=1)

    def _counts(self, t: int, length: int) -> bool:
        return t >= self.base and (length >= LONG or length == self.size[t])

    def _statistics(self, state: int, l: int) -> dict[int, tuple[int, int]]:
        """template -> (length, state) of the longest match that ends here, if it counts."""
        return {t: (l, state) for t in self.auto.at[state] if self._counts(t, l)} | self.above[state]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]], list[Span]]:
        """(number of words, base places (start, end, phrase), template spans)."""
        ws = words(text)
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(0)), dtype=np.int32, count=len(ws))
        known = ids != 0
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        places: list[tuple[int, int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        nxt, link, length, at, above, ends = self.auto.next, self.auto.link, self.auto.length, self.auto.at, self.above, self.ends
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            run = ids[a:b].tolist()
            state = l = 0
            told: dict[int, tuple[int, int]] = {}
            for i, w in enumerate(run):
                while state and w not in nxt[state]:
                    state = link[state]
                    l = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    l += 1
                else:
                    l = 0
                now = self._statistics(state, l) if at[state] or above[state] else {}
                for t, (n, s) in told.items():
                    if t not in now or now[t][0] != n + 1:
                        self._match(matches, t, n, s, a + i)
                told = now
                for n, k in ends[state]:
                    if l >= n:
                        places.append((a + i - n + 1, a + i + 1, k))
            for t, (n, s) in told.items():
                self._match(matches, t, n, s, b)
        return len(ws), places, self._chain(matches)

    def _match(self, matches: dict, t: int, l: int, state: int, end: int) -> None:
        matches.setdefault(t, []).extend((end - l, end, i + 1 - l) for i in self.auto.at[state][t] if i + 1 >= l)

    def _chain(self, matches: dict) -> list[Span]:
        """Spans of the best chains: words covered, matches in order in text and template, gaps of GAP words at most."""
        spans = []
        for t, found in matches.items():
            found.sort(key=lambda m: (m[1], m[0], m[2]))
            best, back = [], []
            for j, (s, e, p) in enumerate(found):
                most, via = e - s, -1
                for i in range(j - 1, -1, -1):  # ends do not fall, so what lies further back is out of reach
                    s0, e0, p0 = found[i]
                    if e0 < s - GAP:
                        break
                    if s0 < s and e0 < e and p0 < p and best[i] + e - max(s, e0) > most:
                        most, via = best[i] + e - max(s, e0), i
                best.append(most)
                back.append(via)
            taken: list[tuple[int, int]] = []
            for j in sorted(range(len(found)), key=lambda j: (-best[j], found[j])):
                if best[j] < COVER * self.size[t]:
                    break
                i = j
                while back[i] >= 0:
                    i = back[i]
                a, b = found[i][0], found[j][1]
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    spans.append(Span(self.labels[t], a, b, min(1.0, best[j] / self.size[t])))
        return sorted(spans, key=lambda s: (s.start, s.end, s.label))


_loaded: dict[tuple, Scanner] = {}


def scanner(templates: tuple = TEMPLATES) -> Scanner:
    if templates not in _loaded:
        _loaded[templates] = Scanner(templates)
    return _loaded[templates]


def templates(table: DataFrame, most: int = 10_000) -> tuple[tuple[str, str], ...]:
    """(label, text) pairs of a table of licence texts, of at most ``most`` rows; more is an error, as nothing is left out."""
    rows = table.where("label is not null and text is not null").select("label", "text").distinct().orderBy("label", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} licence texts")
    return tuple((r.label, r.text) for r in rows)


def folder_templates(spark: SparkSession, folder: str, most: int = 10_000) -> tuple[tuple[str, str], ...]:
    """(label, text) pairs of a folder of licence texts, one file each; the label is the file's name without ``.txt``."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_replace(F.lower(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)), r"\.txt$", "").alias("label"), F.col("value").alias("text"))
    return templates(files, most)


SCHEMA = "doc_id long, n_words long, places array<struct<start:int,end:int,label:string>>, spans array<struct<label:string,start:int,end:int,cover:double>>"


def scan(documents: DataFrame, texts: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, spans): places of base phrases and covered template spans, in words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(texts)
        for b in batches:
            n, places, spans = [], [], []
            for t in C.text_bytes(b.column(1)):
                count, p, c = s.scan(t)
                n.append(count)
                places.append([{"start": x, "end": y, "label": s.labels[k]} for x, y, k in p])
                spans.append([vars(x) for x in c])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))),
                 pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cover", pa.float64())])))],
                ["doc_id", "n_words", "places", "spans"],
            )

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def summary(scanned: DataFrame) -> DataFrame:
    """scan() in one flat row per document; score: the best cover (1 where a base phrase stands)."""
    return scanned.selectExpr(
        "doc_id", "n_words", "cast(size(places) as long) n_base",
        "cast(array_min(transform(places, p -> p.start)) as long) first_word", "cast(array_max(transform(places, p -> p.start)) as long) last_word",
        "array_join(array_sort(array_distinct(transform(places, p -> p.label))), ',') base_labels",
        "array_join(array_sort(array_distinct(concat(transform(places, p -> p.label), transform(spans, s -> s.label)))), ',') labels",
        "CASE WHEN size(places) > 0 THEN 1.0D ELSE coalesce(array_max(transform(spans, s -> s.cover)), 0.0D) END score", "spans",
    )
