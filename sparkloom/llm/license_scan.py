"""License scans (operator 3): notices of known licenses in texts.

The templates' word k-grams are winnowed (the least hash of each WINDOW
neighbours is kept) into an inverted index from fingerprint to template and
place; the index is broadcast, and its size is checked against MOST_FINGERPRINTS.
A template of fewer than SHORT words is cut instead into one piece more than the words that
may be missing at the coverage, so that as many changed, dropped or added words leave one piece whole;
of the ways to cut it the one whose shortest piece has most letters is taken, and
pieces of over GRAM words stand in by their longest gram.
Every word gram of a text, of each length in use, is looked up. Hits of one template on nearby
diagonals (place in the text less place in the template) form a candidate,
which a local alignment in a band around them verifies (a match counts MATCH, a miss or a gap -1, so that single edits don't end it). It gives the number of
matched words (coverage of the template) and the matched span. What a candidate
holds before and behind its match is scanned again until nothing reaches the
coverage, so copies that stand close together all count. Of matches that
overlap, the one with more matched words stays.

Cases: a null or empty text has no matches and so no rows; a text may match
several times; rows may repeat; an empty table gives an empty table; only
doc_id and text are read. Words are runs of ASCII letters and digits and of
bytes beyond ASCII, without case.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import code_points, grams, pieces, slices, tokens
from .common import texts

GRAM, WINDOW, BAND, SHORT, MATCH = 3, 3, 8, 24, 3
COVERAGE = 0.75
MOST_FINGERPRINTS = 1_000_000
_INSIDE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])

#: Notices as their licenses ask for them or as they are commonly put.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def template_words(text: str) -> np.ndarray:
    """Word hashes of one text."""
    return next(tokens(p, _INSIDE, lower=True).hash for p in slices(pa.array([text or " "])))


def winnowed(h: np.ndarray, k: int = GRAM, window: int = WINDOW) -> list[tuple[int, int]]:
    """(fingerprint, place) of a token sequence: the rightmost least k-gram hash of each window."""
    g = grams(h, min(k, len(h))) if len(h) else h
    picked = {}
    for i in range(max(1, len(g) - window + 1) if len(g) else 0):
        part = g[i : i + window]
        at = i + len(part) - 1 - int(np.argmin(part[::-1]))
        picked[at] = int(g[at])
    return [(f, at) for at, f in sorted(picked.items())]


def cut(lengths: list[int], missing: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of a template with words of these lengths, one more than `missing`: the cut whose shortest piece in letters is longest."""
    n = len(lengths)
    ahead = np.r_[0, np.cumsum(lengths)].tolist()
    best: dict[tuple[int, int], tuple[int, list[int]]] = {(i, 1): (ahead[i], [i]) for i in range(1, n + 1)}
    for parts in range(2, missing + 2):
        for i in range(parts, n + 1):
            best[i, parts] = max((min(best[k, parts - 1][0], ahead[i] - ahead[k]), [*best[k, parts - 1][1], i]) for k in range(parts - 1, i))
    ends = best[n, missing + 1][1]
    return [(a, b - a) for a, b in zip([0, *ends], ends, strict=False)]


class Index:
    """Inverted index of the templates: for each gram length, places (template, word) by fingerprint."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = list(templates)
        self.words = [template_words(t) for t in templates.values()]
        if any(len(w) == 0 for w in self.words):
            raise ValueError("a template has no words")
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        rows = 0
        for t, (w, text) in enumerate(zip(self.words, templates.values(), strict=True)):
            missing = len(w) - max(1, -int(-coverage * len(w) // 1))
            if len(w) >= SHORT:
                found = [(GRAM, f, at) for f, at in winnowed(w)]
            else:
                own = tokens(next(slices(pa.array([text]))), _INSIDE, lower=True)
                letters = (own.end - own.start).tolist()
                found = []
                for at, n in cut(letters, missing):
                    size = min(n, GRAM)
                    at = max(range(at, at + n - size + 1), key=lambda i: sum(letters[i : i + size]))
                    found.append((size, int(grams(w[at : at + size], size)[0]), at))
            for size, f, at in found:
                self.places.setdefault(size, {}).setdefault(f, []).append((t, at))
            rows += len(found)
        if rows > MOST_FINGERPRINTS:
            raise ValueError("the templates have too many fingerprints to broadcast")
        self.known = {size: np.array(sorted(own), np.uint64) for size, own in sorted(self.places.items())}

    def hits(self, h: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(gram length, places of hits, their fingerprints) in a sequence of word hashes."""
        out = []
        for size, known in self.known.items():
            g = grams(h, size)
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g)
            out.append((size, hit, g[hit]))
        return out

    def candidates(self, found: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
        """(template, least and greatest diagonal) of each group of hits: the diagonals of neighbours differ by at most BAND."""
        hits: dict[int, list[int]] = {}
        for size, places, fingerprints in found:
            for i, f in zip(places.tolist(), fingerprints.tolist(), strict=True):
                for t, place in self.places[size][f]:
                    hits.setdefault(t, []).append(i - place)
        out = []
        for t, diagonals in sorted(hits.items()):
            diagonals = sorted(set(diagonals))
            low = diagonals[0]
            for d, after in zip(diagonals, [*diagonals[1:], None], strict=True):
                if after is None or after - d > BAND:
                    out.append((t, low, d))
                    low = after
        return out


def aligned(h: list[int], t: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment of the template t in the words h within diagonals low .. high: matched words, first and last word (exclusive). Of equal scores the one with more matches, then the one that ends first."""
    best = (0, 0, 0, 0)  # score, matched, first, end
    above: dict[int, tuple[int, int, int]] = {}
    for j, word in enumerate(t):
        row: dict[int, tuple[int, int, int]] = {}
        for i in range(max(0, j + low), min(len(h), j + high + 1)):
            diagonal = above.get(i - 1, (0, 0, i))
            same = h[i] == word
            cell = (diagonal[0] + (MATCH if same else -1), diagonal[1] + same, diagonal[2])
            for other in (above.get(i), row.get(i - 1)):
                if other and (other[0] - 1, other[1]) > cell[:2]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] >= 0 and cell[1]:
                row[i] = cell
                if cell[:2] > best[:2]:
                    best = (*cell, i + 1)
        above = row
    return best[1], best[2], best[3]


def spans(first: int, end: int, length: int) -> list[tuple[int, int]]:
    """The words first .. end, if they are many, in overlapping parts that hold any match of a template of this length whole: with gaps, a match has fewer than (MATCH + 1) * length words."""
    whole = (MATCH + 1) * length
    most = 2 * (whole + 2 * BAND)
    return [(i, min(end, i + most)) for i in range(first, max(first + 1, end - whole), most - whole)]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, n_matched (words), coverage (matched share of the template), start and end (code points) of each match."""
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, coverage))
    names = ["doc_id", "license", "n_matched", "coverage", "start", "end"]

    def matches(h: np.ndarray, hits: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        known, found = index.value, []
        for t, low, high in known.candidates(hits):
            template = known.words[t].tolist()
            rest = spans(max(0, low - BAND), min(len(h), high + BAND + len(template) + 1), len(template))
            while rest:
                first, end = rest.pop()
                if end - first < coverage * len(template):
                    continue
                matched, a, b = aligned(h[first:end].tolist(), template, low - BAND - first, high + BAND - first)
                if matched >= coverage * len(template):
                    found.append((matched, t, a + first, b + first))
                    rest += [(first, a + first), (b + first, end)]
        taken: list[tuple[int, int, int, int]] = []  # by place, apart
        for m in sorted(found, key=lambda m: (-m[0], m[2], m[1])):
            i = bisect_left(taken, m[2], key=lambda x: x[2])
            if (i == 0 or taken[i - 1][3] <= m[2]) and (i == len(taken) or m[3] <= taken[i][2]):
                taken.insert(i, m)
        return taken

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for b in pieces(batches, "text", 8 << 20):
            out: list[tuple] = []
            for part in slices(b["text"]):
                w = tokens(part, _INSIDE, lower=True)
                hits = known.hits(w.hash)
                own = [(size, at, f, np.searchsorted(w.first, at, "right") - 1) for size, at, f in hits]
                for r in np.unique(np.concatenate([row for *_, row in own])).tolist() if own else []:
                    x, y = int(w.first[r]), int(w.first[r + 1])
                    inside = [(size, at[k] - x, f[k]) for size, at, f, row in own for k in [(row == r) & (at + size <= y)]]
                    for matched, t, s, e in matches(w.hash[x:y], inside):
                        text = part.data[part.bounds[r] : part.bounds[r + 1]]
                        points = code_points(text)
                        start, end = int(points[: w.start[x + s] - part.bounds[r]].sum()), int(points[: w.end[x + e - 1] - part.bounds[r]].sum())
                        out.append((part.first + r, known.names[t], matched, round(matched / len(known.words[t]), 6), start, end))
            if out:
                r, *rest = zip(*out, strict=True)
                yield pa.record_batch([b["doc_id"].take(pa.array(r)), pa.array(rest[0]), pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.float64()), pa.array(rest[3], pa.int64()), pa.array(rest[4], pa.int64())], names)

    return texts(docs).mapInArrow(run, "doc_id long, license string, n_matched long, coverage double, start long, end long")
