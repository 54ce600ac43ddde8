"""Licence scans with a generalised suffix automaton of licence tokens.

All licence templates, from one-line statements to the paragraphs of notices, go into one suffix automaton over word
numbers. A text streams through it word by word; the state and its length are the matching statistics: how many of the
last words stand together somewhere in a template. A match that no longer word extends is kept if it is long
(`Params.long` words, or the whole of a shorter template) and placed in every template that holds it. Matches in the
same order in text and template, at most `Params.gap` words apart, chain into a span; a span that covers `Params.cover`
of its template gives the text the template's label.

The base phrases are templates too. A phrase ends at a word if its state lies on the suffix path of the word's state, so
the same pass finds all their places.

Words that no template has reset the automaton, so only runs of template words are walked. The walk takes time in
proportion to the text: spans of one template open and close from left to right, and at most one is open per template.
The automaton follows from the templates alone; each task builds it once. Rows are mapped where they lie, without a
shuffle.

Results for odd rows: null, empty and wordless texts have no words, no places, no labels and score 0. Rows without an id
and repeated rows get a result each; an empty table gives an empty result. Very long texts are walked whole. Only doc_id
and text are read; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words

#: Separators of the word rule `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[0x30:0x3A] = False
SEPARATOR[0x61:0x7B] = False
SEPARATOR[0x80:] = False

# The base phrases with their labels.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Statements and notices of public licences, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
               "the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc0", "Licensed under CC0 1.0"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
)


@dataclass(frozen=True)
class Params:
    base: Sequence[tuple[str, str]] = BASE
    templates: Sequence[tuple[str, str]] = TEMPLATES
    long: int = 8  # words of a match that counts; the whole template if it is shorter
    gap: int = 12  # words between two matches of a span, in the text and in the template
    cover: float = 0.6  # share of a template's words that a span must cover for its label


DEFAULT = Params()


def split(text: str) -> list[bytes]:
    """The words of one text (templates and phrases; whole columns go through `words.slices`)."""
    return [s.word_bytes(i) for s in words.slices(pa.array([text]), separator=SEPARATOR) for i in range(len(s.starts))]


@dataclass
class Automaton:
    """The generalised suffix automaton of some token sequences, over token numbers.

    State 0 is the root. `longest` is the length of a state's longest string and `link` the state of the longest suffix
    that occurs elsewhere too. `ends[state]` lists (sequence, words up to the end) of all places of its strings.
    """

    sequences: list[list[int]]
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def __post_init__(self) -> None:
        own: list[tuple[int, int, int]] = []
        for number, tokens in enumerate(self.sequences):
            state = 0
            for place, token in enumerate(tokens):
                state = self._extend(state, token)
                own.append((state, number, place + 1))
        places: list[set[tuple[int, int]]] = [set() for _ in self.step]
        for state, number, end in own:
            while state > 0 and (number, end) not in places[state]:
                places[state].add((number, end))
                state = self.link[state]
        self.ends = [sorted(p) for p in places]

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, token: int) -> int:
        """The state of exactly the strings of `state` followed by `token`: split off where longer strings share it."""
        there = self.step[state][token]
        if self.longest[there] == self.longest[state] + 1:
            return there
        copy = self._state(self.longest[state] + 1, dict(self.step[there]), self.link[there])
        self.link[there] = copy
        while state >= 0 and self.step[state].get(token) == there:
            self.step[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, state: int, token: int) -> int:
        if token in self.step[state]:  # an earlier sequence had this prefix
            return self._split(state, token)
        new = self._state(self.longest[state] + 1, {}, 0)
        while state >= 0 and token not in self.step[state]:
            self.step[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token)
        return new

    def statistics(self, tokens: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(state, length) after each token: the longest suffix so far that stands in a sequence."""
        step, link, longest = self.step, self.link, self.longest
        state = length = 0
        for token in tokens:
            following = step[state].get(token)
            while following is None and state:
                state = link[state]
                length = longest[state]
                following = step[state].get(token)
            if following is None:
                length = 0
            else:
                state, length = following, length + 1
            yield state, length


@dataclass
class Span:
    """A template found in a text: words first..last (last excluded), and how many template words are covered."""

    template: int
    first: int
    last: int
    covered: int
    at: int  # where the template goes on


def _runs(tokens: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Runs of at least `least` template words inside one text; a shorter one holds neither a phrase nor a match that counts."""
    edge = np.empty(len(tokens) + 1, bool)
    known = tokens >= 0
    edge[0], edge[-1] = True, True
    np.not_equal(known[1:], known[:-1], out=edge[1:-1])
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    keep = known[edges[:-1]] & (np.diff(edges) >= least) if len(tokens) else np.zeros(0, bool)
    return zip(edges[:-1][keep].tolist(), edges[1:][keep].tolist())


class Scanner:
    """The automaton with what a scan needs to know of its states."""

    def __init__(self, p: Params = DEFAULT):
        self.p = p
        texts = [split(phrase) for phrase, _ in p.base] + [split(text) for _, text in p.templates]
        self.numbers = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.auto = Automaton([[self.numbers[w] for w in t] for t in texts])
        self.sizes = [len(t) for t in texts]
        self.labels = [label for _, label in p.base] + [label for label, _ in p.templates]
        self.n_base = len(p.base)
        self.least = [min(p.long, n) for n in self.sizes]
        self.shortest = min([n for n in (*self.sizes[: self.n_base], *self.least[self.n_base :]) if n], default=1)
        # the phrases whose state is on a state's suffix path, with the length that the state itself needs
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.auto.step]
        for phrase in range(self.n_base):
            state = 0
            for token in self.auto.sequences[phrase]:
                state = self.auto.step[state][token]
            for other in range(1, len(self.auto.step)):
                up = other
                while up > 0 and up != state:
                    up = self.auto.link[up]
                if up == state and state:
                    self.phrases[other].append((phrase, self.sizes[phrase]))
        self.known = list(self.numbers)
        self.hashes = np.array([words.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in self.known], np.uint64)
        self.order = np.argsort(self.hashes)
        self.hashes = self.hashes[self.order]

    def tokens(self, s: words.Slice) -> np.ndarray:
        """The number of every word of a slice, -1 where no template has it. A hash finds the candidate, the bytes decide."""
        if not len(self.hashes):
            return np.full(len(s.starts), -1)
        h = s.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == h, self.order[at], -1)
        for first, last in _runs(out, s.word_offsets, self.shortest):
            for i in range(first, last):
                if s.word_bytes(i) != self.known[out[i]]:
                    out[i] = -1
        return out

    def scan(self, tokens: np.ndarray) -> tuple[list[tuple[int, int]], list[Span]]:
        """(start, phrase) of all base places, and all spans, of one text given as word numbers."""
        places: list[tuple[int, int]] = []
        opened: dict[int, Span] = {}
        spans: list[Span] = []
        for first, last in _runs(tokens, np.array([0, len(tokens)]), self.shortest):
            self._run(tokens[first:last].tolist(), first, places, opened, spans)
        spans.extend(opened.values())
        return places, spans

    def _run(self, run: list[int], first: int, places: list, opened: dict[int, Span], spans: list[Span]) -> None:
        before, length_before = 0, 0
        for i, (state, length) in enumerate(self.auto.statistics(run)):
            if length <= length_before:  # the match that ended one word earlier could not be extended
                self._match(before, length_before, first + i, opened, spans)
            for phrase, size in self.phrases[state]:
                if length >= size:
                    places.append((first + i + 1 - size, phrase))
            before, length_before = state, length
        self._match(before, length_before, first + len(run), opened, spans)

    def _match(self, state: int, length: int, end: int, opened: dict[int, Span], spans: list[Span]) -> None:
        """Chain a maximal match of the words end - length..end into the span of each template that holds it."""
        if length < 2:
            return
        nearest: dict[int, int] = {}
        for template, stop in self.auto.ends[state]:
            if template < self.n_base or length < self.least[template]:
                continue
            span = opened.get(template)
            # of several places in a template, the first that continues the open span, else the first of all
            fits = span is not None and self._continues(span, end - length, stop, length)
            if template not in nearest or (fits and not self._continues(span, end - length, nearest[template], length)):
                nearest[template] = stop
        for template, stop in nearest.items():
            span = opened.get(template)
            if span is not None and self._continues(span, end - length, stop, length):
                new = min(length, end - span.last, stop - span.at)
                span.covered, span.last, span.at = span.covered + new, end, stop
            else:
                if span is not None:
                    spans.append(span)
                opened[template] = Span(template, end - length, end, length, stop)

    def _continues(self, span: Span, start: int, stop: int, length: int) -> bool:
        return stop > span.at and start + length > span.last and start - span.last <= self.p.gap and stop - length - span.at <= self.p.gap

    def verdict(self, tokens: np.ndarray) -> tuple[int, int | None, int | None, str, str, float, list[Span]]:
        places, spans = self.scan(tokens)
        starts = [s for s, _ in places]
        base = {self.labels[p] for _, p in places}
        cover = [(s.covered / self.sizes[s.template], s) for s in spans]
        found = [s for c, s in cover if c >= self.p.cover]
        labels = base | {self.labels[s.template] for s in found}
        score = max((c for c, _ in cover), default=0.0)
        if base:
            score = 1.0  # a phrase stands whole
        return len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found


FORM = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:long,last:long,cover:double>>")
_TYPES = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))),
])


def _scan(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(p)
        for batch in batches:
            for s in words.slices(batch.column("text"), separator=SEPARATOR):
                tokens, at = scanner.tokens(s), s.word_offsets
                rows = []
                for i in range(s.last - s.first):
                    *digest, found = scanner.verdict(tokens[at[i] : at[i + 1]])
                    rows.append((int(at[i + 1] - at[i]), *digest, [
                        {"label": scanner.labels[x.template], "first": x.first, "last": x.last - 1, "cover": x.covered / scanner.sizes[x.template]} for x in found]))
                columns = [batch.column("doc_id").slice(s.first, s.last - s.first)]
                columns += [pa.array(c, t.type) for c, t in zip(zip(*rows), list(_TYPES)[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema=_TYPES)

    return run


def scan(docs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest
    share of a template that a span covers; 1 with a base phrase), spans (label, first and last word, covered share)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(p), FORM)
