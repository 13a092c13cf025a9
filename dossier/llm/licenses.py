"""License scans: matching statistics of whole texts against a generalised suffix automaton of license templates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import alnum_words, over_batches, slices

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Opening grants and disclaimers of widely used licenses, as published.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
            "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
                   "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial"),
)
#: Shortest match, in words, that a chain is made of; words that a chain may skip on either side; share of a template that a chain must cover.
LEAST_MATCH, GAP, LEAST_COVER = 5, 8, 0.5

RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,start:long,end:long,cover:double>>")


class Automaton:
    """Suffix automaton of several word sequences: every path from the root is a run of words of some sequence."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for i, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, start=1):
                last = self._extend(last, word)
                self.ends[last].add((i, end))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, size: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _clone(self, parent: int, word: int, old: int) -> int:
        copy = self._state(self.size[parent] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.size[there] == self.size[last] + 1 else self._clone(last, word, there)
        new = self._state(self.size[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[new] = old if self.size[old] == self.size[at] + 1 else self._clone(at, word, old)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Matching statistics: state and length of the longest run that ends with ``word``."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        after = self.next[state].get(word)
        return (0, 0) if after is None else (after, length + 1)


class Scanner:
    """Automaton, phrases and template lengths, made once in every worker."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES) -> None:
        texts = [*phrases, *((text, label) for label, text in templates)]
        words = [alnum_words(text) for text, _ in texts]
        self.number: dict[bytes, int] = {}
        sequences = [[self.number.setdefault(w, len(self.number)) for w in one] for one in words]
        self.labels = [label for _, label in texts]
        self.sizes = [len(one) for one in sequences]
        self.n_phrases = len(phrases)
        self.automaton = Automaton(sequences)
        self.phrases_at = self._phrases_at()

    def _phrases_at(self) -> list[tuple[int, ...]]:
        """Phrases that end where a state does: those ending in the state itself or in one that its links lead to."""
        sam = self.automaton
        own: list[list[int]] = [[] for _ in sam.size]
        for state, ends in enumerate(sam.ends):
            shortest = sam.size[sam.link[state]] + 1 if state else 0
            own[state] = [i for i, end in ends if i < self.n_phrases and end == self.sizes[i] and shortest <= end <= sam.size[state]]
        for state in sorted(range(1, len(sam.size)), key=sam.size.__getitem__):
            own[state] = own[state] + own[sam.link[state]]
        return [tuple(sorted(set(one))) for one in own]

    def scan(self, text: str | None) -> tuple:
        """One row of RESULT."""
        words = alnum_words(text)
        number = self.number.get
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        sam = self.automaton
        state = length = 0
        after = -2
        for at in [i for i, w in enumerate(words) if w in self.number]:
            if at != after + 1 and length:
                if length >= LEAST_MATCH:
                    matches.append((after + 1 - length, after + 1, state))
                state = length = 0
            before, was = state, length
            state, length = sam.step(state, length, number(words[at]))
            if was >= LEAST_MATCH and length <= was:
                matches.append((after + 1 - was, after + 1, before))
            for i in self.phrases_at[state]:
                if self.sizes[i] <= length:
                    places.append((at + 1 - self.sizes[i], i))
            after = at
        if length >= LEAST_MATCH:
            matches.append((after + 1 - length, after + 1, state))
        spans = self._chained(matches)
        base = {self.labels[i] for _, i in places}
        starts = [start for start, _ in places]
        labels = base | {label for label, *_ in spans}
        score = 1.0 if base else max((cover for *_, cover in spans), default=0.0)
        found = [{"label": label, "start": start, "end": end, "cover": cover} for label, start, end, cover in spans]
        return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found)

    def _chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches that go forward in text and template with short gaps; of each template those that cover enough of it."""
        by_template: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, end, state in matches:
            for i, template_end in self.automaton.ends[state]:
                if i >= self.n_phrases:
                    by_template.setdefault(i, []).append((start, end, template_end - (end - start), template_end))
        out = []
        for i, hits in by_template.items():
            chains: list[list[int]] = []  # start, end, end in the template, words covered
            open_: list[list[int]] = []
            for start, end, low, high in sorted(hits):
                # what ends too far in front is out of reach for all further hits too
                chains += [c for c in open_ if start - c[1] > GAP]
                open_ = [c for c in open_ if start - c[1] <= GAP]
                fits = [c for c in open_ if start >= c[1] and 0 <= low - c[2] <= GAP]
                best = max(reversed(fits), key=lambda c: c[3], default=None)
                if best is not None:
                    open_.remove(best)
                    open_.append([best[0], end, high, best[3] + high - low])
                else:
                    open_.append([start, end, high, high - low])
                open_.sort(key=lambda c: c[1])
            chains += open_
            out += [(self.labels[i], c[0], c[1], c[3] / self.sizes[i]) for c in chains if c[3] >= LEAST_COVER * self.sizes[i]]
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates=templates)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def _scanned(batches: Iterator[pa.RecordBatch], templates: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    scan = _scanner(templates).scan
    for batch in slices(batches):
        rows = [scan(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), _TYPES))], ["doc_id", *_NAMES])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id``, the words, base places and labels of every row, and ``spans`` of template text with the share covered.

    Every task streams its texts through one automaton of all phrases and templates, which gives at each word the longest run of template words that
    ends there. Phrases are read off the states; matches of five words or more are chained to spans, and a template that a chain covers by half
    or more gives its label. ``templates`` are pairs of label and text, of any number that a worker's automaton should hold; the built-in ones are openings of
    licenses. ``score`` is the largest share covered, 1 for a base phrase, else 0. Nothing is shuffled, and the automaton is of fixed size.

    A null text is empty: no words, no places (null first and last), empty labels, score 0. Repeated rows give repeated rows, null keys stay, no
    rows give none; other columns play no part.
    """
    kind = docs.schema[key].dataType.simpleString()
    return over_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), partial(_scanned, templates=tuple(templates)), f"doc_id {kind}, {RESULT}")
