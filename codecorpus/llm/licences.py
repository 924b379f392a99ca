"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of the templates and phrases. A text is streamed through
it word by word: the state says the longest run of words that ends here and stands in a template
(the matching statistic), suffix links give the shorter ones. Where it is long enough, the
template places of the last words are followed along their diagonals, so each template gets its
own maximal matches, also where another one matches further. Matches of a template that follow
one another closely are chained, and a chain that covers enough of the template is a span.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import texts_of

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text whose words are held at a time.
TILE = 1 << 19

# Phrases with their labels. Each place where the words of one stand is reported.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# Public licence notices with their labels, in the wording of the licences.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed "
                   "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str) -> list[bytes]:
    """A text's words: digits, letters and all characters beyond ASCII, A-Z in lower case."""
    return _WORD.findall(text.encode().lower())


class Automaton:
    """The generalised suffix automaton of several sequences of words."""

    def __init__(self, sequences: Sequence[Sequence[bytes]], least: int):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        self.whole: list[int] = []  # state of each sequence
        for k, sequence in enumerate(sequences):
            last = 0
            for i, w in enumerate(sequence):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends += [[] for _ in range(len(self.size) - len(ends))]
                ends[last].append((k, i))
            self.whole.append(last)
        self.longest = [len(s) for s in sequences]
        self._order(ends, least)

    def _state(self, size: int, link: int, step: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(step)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's strings followed by c, parted from longer strings of q if need be."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # an earlier sequence has gone here
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def _order(self, ends: list[list[tuple[int, int]]], least: int) -> None:
        """Places of each state as a stretch of one list, along the tree of suffix links; per
        state, the suffix of `least` words, and the sequences that end with a suffix of it."""
        n = len(self.size)
        below: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            below[self.link[v]].append(v)
        self.places: list[tuple[int, int]] = []
        self.stretch = [(0, 0)] * n
        stack = [(0, False)]
        began = [0] * n
        while stack:
            v, done = stack.pop()
            if done:
                self.stretch[v] = (began[v], len(self.places))
                continue
            began[v] = len(self.places)
            self.places += ends[v]
            stack.append((v, True))
            stack += [(w, False) for w in below[v]]
        self.top, self.complete = [0] * n, [()] * n
        own: dict[int, list[int]] = {}
        for k, v in enumerate(self.whole):
            if self.longest[k]:
                own.setdefault(v, []).append(k)
        for v in sorted(range(1, n), key=self.size.__getitem__):
            up = self.link[v]
            self.top[v] = self.top[up] if self.size[up] >= least else v
            self.complete[v] = (*self.complete[up], *own.get(v, ()))

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The matching statistic after a word: state and length of the longest run that ends with it."""
        steps = self.next
        while state and c not in steps[state]:
            state = self.link[state]
            length = self.size[state]
        to = steps[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)


class Scanner:
    """Phrases, chained templates and what they need to be a span."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], least: int, gap: int,
                 share: float):
        # a template of fewer words than a match needs has to stand as a whole, as phrases do
        named = [(label, words_of(text)) for label, text in (*phrases, *templates)]
        self.labels = [label for label, _ in named]
        self.sizes = [len(w) for _, w in named]
        if not all(self.sizes):
            raise ValueError("a phrase or template has no word")
        self.n_phrases, self.least, self.gap, self.share = len(phrases), least, gap, share
        self.exact = [k < len(phrases) or size < least for k, size in enumerate(self.sizes)]
        self.automaton = Automaton([w for _, w in named], least)

    def matches(self, tiles: Iterable[list[bytes]]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(words, whole ones as (which, start), template matches as (which, start, start in it, words))."""
        auto, least = self.automaton, self.least
        get, steps, link, size = auto.ids.get, auto.next, auto.link, auto.size
        top, complete, stretch, places = auto.top, auto.complete, auto.stretch, auto.places
        wholes: list[tuple[int, int]] = []
        found: list[tuple[int, int, int, int]] = []
        state = length = base = 0
        before = -2  # the position whose diagonals `active` holds
        active: dict[tuple[int, int], int] = {}
        for words in tiles:
            ids = np.fromiter((-1 if i is None else i for i in map(get, words)), np.int64, len(words))
            known = np.flatnonzero(ids >= 0)
            follows, i = -1, base - 1
            for i, c in zip((known + base).tolist(), ids[known].tolist(), strict=True):
                if i != follows and (follows >= 0 or i != base):
                    state = length = 0  # an unknown word stood between
                follows = i + 1
                while state and c not in steps[state]:
                    state = link[state]
                    length = size[state]
                to = steps[state].get(c)
                state, length = (to, length + 1) if to is not None else (0, 0)
                for k in complete[state]:
                    if self.sizes[k] <= length and self.exact[k]:
                        wholes.append((k, i - self.sizes[k] + 1))
                if length >= least:
                    now = {}
                    low, high = stretch[top[state]]
                    carried = active if before == i - 1 else {}
                    for k, at in places[low:high]:
                        if not self.exact[k]:
                            now[k, at - i] = carried.pop((k, at - i), i - least + 1)
                    self._close(active, before, found)
                    active, before = now, i
            if words and i != base + len(words) - 1:
                state = length = 0  # the tile ends with an unknown word
            base += len(words)
        self._close(active, before, found)
        return base, wholes, found

    @staticmethod
    def _close(active: dict[tuple[int, int], int], last: int, found: list[tuple[int, int, int, int]]) -> None:
        found += [(k, start, start + diagonal, last - start + 1) for (k, diagonal), start in active.items()]

    def chains(self, matches: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Best chains: (which, first word, last word, template words covered), none sharing a match.

        A match follows another if it starts later in text and template and at most `gap` words
        behind its end in both; words of an overlap count once.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, *rest in matches:
            by.setdefault(k, []).append(tuple(rest))
        out = []
        for k, own in by.items():
            own.sort()
            reach = self.gap + self.sizes[k]
            best, came = [n for _, _, n in own], [-1] * len(own)
            for i, (s, t, n) in enumerate(own):
                for j in range(i - 1, -1, -1):
                    a, b, m = own[j]
                    if a < s - reach:
                        break
                    behind = min(s - a, t - b) - m  # words between; below zero, an overlap
                    if a < s and b < t and max(s - a, t - b) - m <= self.gap:
                        value = best[j] + n + min(behind, 0)
                        if n + min(behind, 0) > 0 and value > best[i]:
                            best[i], came[i] = value, j
            used = [False] * len(own)
            for i in sorted(range(len(own)), key=lambda i: (-best[i], own[i])):
                if used[i]:
                    continue
                used[i], first = True, i
                while came[first] >= 0 and not used[came[first]]:
                    first = came[first]
                    used[first] = True
                covered = best[i] - (best[came[first]] if came[first] >= 0 else 0)
                out.append((k, own[first][0], own[i][0] + own[i][2] - 1, covered))
        return out

    def scan(self, tiles: Iterable[list[bytes]]) -> tuple[int, list[dict], list[dict], float]:
        """(words, phrases, spans, highest coverage of any template or phrase)."""
        n, wholes, matches = self.matches(tiles)
        phrases = [{"label": self.labels[k], "start": s} for k, s in wholes if k < self.n_phrases]
        spans = [(s, s + self.sizes[k] - 1, k, self.sizes[k]) for k, s in wholes if k >= self.n_phrases]
        spans += [(first, last, k, covered) for k, first, last, covered in self.chains(matches)]
        best = max([c / self.sizes[k] for _, _, k, c in spans], default=0.0)
        kept = [{"label": self.labels[k], "template": k - self.n_phrases, "first": a, "last": b, "covered": c,
                 "coverage": c / self.sizes[k]} for a, b, k, c in self.best_readings(spans)]
        return n, phrases, kept, 1.0 if phrases else best

    def best_readings(self, spans: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Spans that cover enough, without those that share most of their words with one that covers more."""
        kept: list[tuple[int, int, int, int]] = []
        widest = 0
        enough = [s for s in spans if s[3] >= self.share * self.sizes[s[2]]]
        for a, b, k, c in sorted(enough, key=lambda s: (-s[3], -s[3] / self.sizes[s[2]], s)):
            i, beaten = bisect.bisect_right(kept, (b, math.inf)) - 1, False
            while i >= 0 and kept[i][0] > a - widest and not beaten:
                x, y, other, d = kept[i]
                more = (d, d / self.sizes[other]) > (c, c / self.sizes[k])
                beaten = more and 2 * (min(b, y) - max(a, x) + 1) > b - a + 1
                i -= 1
            if not beaten:
                bisect.insort(kept, (a, b, k, c))
                widest = max(widest, b - a + 1)
        return kept


def tiles(text: bytes) -> Iterator[list[bytes]]:
    """A text's words in lower case, of about TILE bytes of it at a time."""
    at = 0
    while at < len(text):
        cut = _NO_WORD.search(text, at + TILE) if at + TILE < len(text) else None
        end = cut.start() if cut else len(text)
        yield _WORD.findall(text[at:end].lower())
        at = end


_scanners: dict[tuple, Scanner] = {}

SPANS = "array<struct<label: string, template: int, first: bigint, last: bigint, covered: bigint, coverage: double>>"
_PHRASES_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_SPANS_TYPE = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()),
                                  ("last", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())]))


def _reader(settings: tuple) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if settings not in _scanners:  # one per worker
            _scanners[settings] = Scanner(*settings)
        scan = _scanners[settings].scan
        for batch in batches:
            view, offsets = texts_of(batch.column("text"))
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n, phrases, spans, score = zip(*(
                    scan(tiles(bytes(view[offsets[k]:offsets[k + 1]]))) for k in range(i, i + part.num_rows)), strict=True)
                yield pa.record_batch(
                    [part.column("key"), pa.array(n, pa.int64()), pa.array(phrases, _PHRASES_TYPE),
                     pa.array(spans, _SPANS_TYPE), pa.array(score, pa.float64())],
                    ["key", "n_words", "phrases", "spans", "score"])
    return read


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text",
            phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
            least: int = 3, gap: int = 12, share: float = 0.7) -> DataFrame:
    """Per row of docs: key, n_words, phrases, spans and score.

    phrases are all places (label, first word from 0) where a phrase's words stand one behind the
    other; spans the chained matches of at least `least` words that cover `share` of a template, unless
    another one covers more in mostly the same place:
    label, which template, first and last word of the text, words of the template covered, and
    their share of it. A template shorter than `least` words has to stand as a whole. score is the
    highest share of any template or phrase, those below `share` included. Null and empty texts have
    no words and score 0. Rows that repeat and null keys give rows of their own; other columns are
    not read. The automaton grows with the templates only.
    """
    settings = (tuple(phrases), tuple(templates), least, gap, share)
    if least < 1:
        raise ValueError("least must be positive")
    Scanner(*settings)  # reports odd templates before the job starts
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        _reader(settings), f"key {kind}, n_words long, phrases array<struct<label: string, start: bigint>>, "
                           f"spans {SPANS}, score double").withColumnRenamed("key", key)
