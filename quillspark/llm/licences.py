"""Licence scans: matching statistics of a generalised suffix automaton, chained into covered template spans.

The automaton holds the terms of all licence templates and is built once per
task; texts stream through it. At every word it knows the longest run of words that ends there and
stands in some template. Long runs are anchors; anchors that go forward in text and
template form chains, and a chain that covers enough of a template is a span of its licence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.terms import numbers_in, term_slices

#: Phrases whose words mark a licence wherever they stand together, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence texts and notices in public use, by label.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    "bsd": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    "isc": ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",),
    "mpl": ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",),
    "unlicense": ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}
#: Words of all templates together; the automaton has at most twice as many states and is sent to every task.
MOST_WORDS = 1_000_000


class Scan(NamedTuple):
    """Thresholds: words of an anchor, words of text or template between anchors of a chain, and the share of a template, and least words, that a span covers."""

    anchor: int = 3
    gap: int = 12
    covered: float = 0.75
    words: int = 5


class Automaton:
    """Generalised suffix automaton over templates of word numbers.

    State 0 is the root. `ends[v]` has a (template, end) pair for every place where the words of state v end.
    """

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(templates):
            at = 0
            for end, word in enumerate(words, 1):
                at = self._extended(at, word)
                own.extend([] for _ in range(len(self.next) - len(own)))
                own[at].append((number, end))
        self.ends = own
        # What ends in a state ends in the state of every suffix too.
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] = self.ends[self.link[v]] + self.ends[v]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, above: int, word: int) -> int:
        """The state that `above` reaches by `word`, made to end exactly one word longer than `above`."""
        there = self.next[above][word]
        if self.length[there] == self.length[above] + 1:
            return there
        copy = self._state(self.length[above] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = copy
        while above >= 0 and self.next[above].get(word) == there:
            self.next[above][word] = copy
            above = self.link[above]
        return copy

    def _extended(self, last: int, word: int) -> int:
        """The state of one more word after `last`, which may exist from an earlier template."""
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of the longest run of template words that ends at each place; places without one are left out. Linear in the words."""
        state = length = 0
        edges, links, lengths = self.next, self.link, self.length
        for place, word in enumerate(words):
            if word < 0:
                state = length = 0
                continue
            while state and word not in edges[state]:
                state = links[state]
                length = lengths[state]
            state = edges[state].get(word, 0)
            if state:
                length += 1
                yield place, length, state


class Found(NamedTuple):
    """A chain: template, first word and end in the text, words covered."""

    template: int
    start: int
    end: int
    covered: int


def chains(anchors: list[tuple[int, int, list[tuple[int, int]]]], gap: int) -> Iterator[Found]:
    """Chains of anchors (end in the text, length, their ends in templates), from left to right.

    Each anchor continues the chain of its template that covers most among those that end before it
    in text and template, at most `gap` words away in both; else it opens one.
    Overlapping words count once. Chains that another continues are left out. Only chains within reach are kept at hand.
    """
    open_: dict[int, list[list]] = {}  # of each template: [end in text, end in template, start in text, covered, continued]
    for end, length, places in anchors:
        for template, place in places:
            held = open_.setdefault(template, [])
            for chain in [c for c in held if c[0] < end - length - gap]:
                if not chain[4]:
                    yield Found(template, chain[2], chain[0], chain[3])
            held[:] = [c for c in held if c[0] >= end - length - gap]
            best, most = None, length
            for chain in held:
                # Words that the chain already covers, in the text or in the template, are taken off the anchor's front.
                cut = max(0, chain[0] - (end - length), chain[1] - (place - length))
                away = place - length + cut - chain[1]
                if cut < length and chain[0] < end and chain[1] < place and away <= gap and chain[3] + length - cut > most:
                    best, most = chain, chain[3] + length - cut
            if best:
                best[4] = True
            held.append([end, place, best[2] if best else end - length, most, False])
    for template, held in open_.items():
        for chain in held:
            if not chain[4]:
                yield Found(template, chain[2], chain[0], chain[3])


class Scanner:
    """Templates and phrases as one automaton over their vocabulary."""

    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str], scan: Scan):
        self.scan = scan
        texts = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, own in sorted(templates.items()) for text in own]
        self.labels = [label for label, _, _ in texts]
        self.n_phrases = len(phrases)
        words = [[terms.slice(a, b - a) for _, _, terms, bounds in term_slices(pa.array([text]), 1 << 30) for a, b in zip(bounds[:-1], bounds[1:])][0] for _, text, _ in texts]
        self.sizes = [len(w) for w in words]
        if sum(self.sizes) > MOST_WORDS:
            raise ValueError(f"the templates have more than {MOST_WORDS} words")
        self.vocabulary = pa.chunked_array(words, pa.large_binary()).unique() if words else pa.array([], pa.large_binary())
        numbers = [numbers_in(w, self.vocabulary).tolist() for w in words]
        self.automaton = Automaton(numbers)
        # Of each state: the phrases that its words end with, shortest first.
        self.phrases: list[list[int]] = [[] for _ in self.automaton.next]
        for number in range(self.n_phrases):
            v = 0
            for word in numbers[number]:
                v = self.automaton.next[v][word]
            if v:
                self.phrases[v].append(number)
        for v in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[v] = self.phrases[self.automaton.link[v]] + self.phrases[v]

    def found(self, words: list[int]) -> tuple[list[tuple[int, int]], list[Found], float]:
        """Places of phrases as (phrase, first word), the spans that cover enough of a template, and the largest share of a template that is covered."""
        whole: list[tuple[int, int]] = []
        anchors: list[tuple[int, int, list[tuple[int, int]]]] = []
        least, phrases, ends = self.scan.anchor, self.phrases, self.automaton.ends
        last = size = state = -1

        def closed() -> None:
            anchors.append((last + 1, size, [e for e in ends[state] if e[0] >= self.n_phrases]))

        for place, length, now in self.automaton.statistics(words):
            # A run that the next word does not lengthen is maximal.
            if size >= least and not (place == last + 1 and length == size + 1):
                closed()
            last, size, state = place, length, now
            for number in phrases[now]:
                if self.sizes[number] <= length:
                    whole.append((number, place + 1 - self.sizes[number]))
        if size >= least:
            closed()
        every = list(chains(anchors, self.scan.gap))
        share = 1.0 if whole else max((min(1.0, f.covered / self.sizes[f.template]) for f in every), default=0.0)
        kept: list[Found] = []
        for f in sorted(every, key=lambda f: (-f.covered, f)):
            if f.covered >= max(self.scan.words, self.scan.covered * self.sizes[f.template]) and all(f.end <= k.start or f.start >= k.end for k in kept if k.template == f.template):
                kept.append(f)
        return whole, sorted(kept, key=lambda f: (f.start, f.template)), share


def _scanned(templates: dict[str, tuple[str, ...]], phrases: dict[str, str], scan: Scan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, scan)
        for batch in batches:
            for first, last, terms, bounds in term_slices(batch.column(1)):
                numbers = numbers_in(terms, scanner.vocabulary)
                rows = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    whole, spans, share = scanner.found(numbers[a:b].tolist())
                    base = {scanner.labels[n] for n, _ in whole}
                    starts = [at for _, at in whole]
                    rows.append(
                        {
                            "n_words": int(b - a),
                            "n_base": len(whole),
                            "first_word": min(starts, default=None),
                            "last_word": max(starts, default=None),
                            "base_labels": ",".join(sorted(base)),
                            "labels": ",".join(sorted(base | {scanner.labels[f.template] for f in spans})),
                            "score": share,
                            "spans": [{"label": scanner.labels[f.template], "start": f.start, "end": f.end, "covered": f.covered, "template_words": scanner.sizes[f.template]} for f in spans],
                        }
                    )
                made = pa.Table.from_pylist(rows, _SCHEMA).combine_chunks()
                head = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([head, *[c.chunk(0) for c in made.columns]], ["doc_id", *made.column_names])

    return run


_SCHEMA = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("template_words", pa.int64())]))),
    ]
)


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES, thresholds: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places of phrases (n_base, first_word, last_word, base_labels), labels, score and spans of every row, without a shuffle.

    A span is a chain of long matches that covers enough of one template: its label, first word, end, covered words and the
    template's words. Places of phrases are exact and come from the automaton too: phrases are templates of it.
    labels adds those of the spans to those of the phrases; score is the largest share of a template that a chain covers, 1 with a phrase.
    Null and empty texts have no words, no labels, score 0 and null places. Texts of any length are scanned whole.
    Repeated rows give repeated results, further columns are not read, and an empty table gives no rows.
    The templates go to every task and have MOST_WORDS words at most, else this raises ValueError.
    """
    Scanner(templates, phrases, thresholds)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<label: string, start: long, end: long, covered: long, template_words: long>>"
    return rows.mapInArrow(_scanned(templates, phrases, thresholds), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {spans}")
