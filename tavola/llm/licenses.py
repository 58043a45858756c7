"""Licence scan: Dice coefficient of word bigrams against licence templates.

A unit of text (a whole document, and every line of it) is normalised to lower
case words of letters and digits; its set of word bigrams meets the templates'
sets.  With a and b bigrams, Dice = 2 * common / (a + b) can reach the
threshold t only if b lies between a * t / (2 - t) and a * (2 - t) / t, so a
unit is compared with templates of an admissible size only.  For the same
reason common is at least b * t / (2 - t): a text that holds fewer of a
template's bigrams has no unit that meets it, and is done after one pass.

Where the whole text meets no template, blocks are units too: windows of words
that run over a line's end, or lie in a line too long for the template (and
meeting none itself).  The best window starts and ends where a stretch of the
template's bigrams does, as a bigram of the template never lowers Dice, and its
first stretch holds a bigram that does not come again; these windows alone are
compared.

Defined results: null and empty texts, and units of fewer than two words, meet
no template; the unit of a block is the line it starts in; of equal scores
lines come before blocks, then the first unit, then the first template by name
count; a block inside a longer block of another template gives way to it;
blocks count as units if they touch no line that meets a template and no
better block; every input row gives one row, null and repeated ids
included; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import LOWER, UPPER
from tavola.llm.license_texts import TEXTS

THRESHOLD = 0.8

# Short licence notices, the opening paragraphs of licence texts, and whole texts, as published.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT licensed": "Licensed under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 deed": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All rights reserved": "All rights reserved.",
} | {name: " ".join(text.split()) for name, text in TEXTS.items()}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def admissible(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit with which a template of ``size`` bigrams can reach the threshold."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


# Bytes to words: A-Z in lower case, all but letters and digits (also of other scripts) to spaces.
_PLAIN = bytes(LOWER.encode()[UPPER.encode().index(c)] if c in UPPER.encode() else c if c in LOWER.encode() + b"0123456789" else 32 for c in range(256))


def apart(blocks: list[tuple], first: int, last: int) -> bool:
    """Whether the pairs from first to last share no word with any of the blocks."""
    return all(last + 1 < b[4] or b[5] + 1 < first for b in blocks)


class Scanner:
    """The templates' bigrams, and the comparison of a text with them."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.names = list(templates)
        pairs = [[tuple(p.encode().split()) for p in bigrams_of(t)] for t in templates.values()]
        self.sizes = list(map(len, pairs))
        self.bounds = [admissible(n, threshold) for n in self.sizes]
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for k, own in enumerate(pairs):
            for p in own:
                self.holders.setdefault(p, []).append(k)
        self.vocabulary = {w for p in self.holders for w in p}

    def candidates(self, pairs: set) -> dict[int, set]:
        """Per template that a unit of the text may meet: its bigrams in the text."""
        known: dict[int, set] = {}
        for p in pairs & self.holders.keys():
            for k in self.holders[p]:
                known.setdefault(k, set()).add(p)
        return {k: found for k, found in known.items() if len(found) >= max(self.bounds[k][0], 1)}

    def dice(self, common: int, size: int, k: int) -> float:
        return 2.0 * common / (size + self.sizes[k])

    def compare(self, pairs: set, known: dict[int, set]) -> list[tuple[float, int]]:
        """(-dice, template) of the templates that a unit of these bigrams meets."""
        found = []
        for k, own in known.items():
            if self.bounds[k][0] <= len(pairs) <= self.bounds[k][1] and (d := self.dice(len(pairs & own), len(pairs), k)) >= self.threshold:
                found.append((-d, k))
        return found

    def windows(self, pairs: list, k: int, own: set):
        """(-dice, first pair, last pair) of the windows that meet template ``k``, from and to the ends of its stretches."""
        low = self.bounds[k][0]
        inside = [p in own for p in pairs]
        starts = [i for i, x in enumerate(inside) if x and not (i and inside[i - 1])]
        left: set = set()
        ahead = []  # bigrams of the template from each start on
        for i in range(len(pairs) - 1, -1, -1):
            if inside[i]:
                left.add(pairs[i])
                if not (i and inside[i - 1]):
                    ahead.append(len(left))
        for i, rest in zip(starts, reversed(ahead)):
            if rest < low:
                break
            spare = rest * (2 - self.threshold) / self.threshold - self.sizes[k] + 1e-9  # other bigrams that a window from here may hold
            seen: set = set()
            common, first, only = 0, True, set()
            for j in range(i, len(pairs)):
                p = pairs[j]
                if p not in seen:
                    seen.add(p)
                    common += inside[j]
                    if len(seen) - common > spare:
                        break
                if first:
                    only.add(p)
                else:
                    only.discard(p)
                    if not only:  # without the first stretch the window holds the same bigrams of the template
                        break
                if inside[j] and (j + 1 == len(pairs) or not inside[j + 1]):
                    first = False
                    if low <= len(seen) and (d := self.dice(common, len(seen), k)) >= self.threshold:
                        yield -d, i, j

    def blocks(self, lines: list[list[bytes]], known: dict[int, set], hit: set[int]) -> list[tuple]:
        """(-dice, first line, name, last line, first pair, last pair) of the blocks, best first: of each template those
        that overlap no better one, without those inside a longer block of another template."""
        words = [w for own in lines for w in own]
        line_of = [i for i, own in enumerate(lines, 1) for _ in own]
        pairs = list(zip(words, words[1:]))
        sizes = {i: len(set(zip(own, own[1:]))) for i, own in enumerate(lines, 1)}
        found = []
        for k, own in known.items():
            mine: list[tuple] = []
            for less, i, j in sorted(self.windows(pairs, k, own)):
                a, b = line_of[i], line_of[j + 1]
                if (a < b or a not in hit and sizes[a] > self.bounds[k][1]) and apart(mine, i, j):
                    mine.append((less, a, self.names[k], b, i, j))
            found += mine
        return sorted(x for x in found if not any(y[4] <= x[4] and x[5] <= y[5] and y[5] - y[4] > x[5] - x[4] for y in found))

    def scan(self, text: str | None) -> tuple[str | None, float | None, int | None, int]:
        """license, dice, unit, n_units."""
        data = (text or "").encode("utf-8", "replace")
        words = data.translate(_PLAIN).split()
        if len(self.vocabulary.intersection(words)) < 2:
            return None, None, None, 0
        pairs = set(zip(words, words[1:]))
        known = self.candidates(pairs)
        if not known:
            return None, None, None, 0
        lines = [x.translate(_PLAIN).split() for x in data.split(b"\n")]
        whole = [(less, 0, self.names[k]) for less, k in self.compare(pairs, known)]
        hits = whole + [(less, i, self.names[k]) for i, own in enumerate(lines, 1) for less, k in self.compare(set(zip(own, own[1:])), known)]
        units = {h[1] for h in hits}
        count, best = len(units), min(hits, default=None)
        if not whole:
            taken = set(units)
            used: list[tuple] = []
            for b in self.blocks(lines, known, units):
                if best is None or b[0] < best[0]:
                    best = b
                if taken.isdisjoint(range(b[1], b[3] + 1)) and apart(used, b[4], b[5]):
                    used.append(b)
            count += len(used)
        return (best[2], -best[0], best[1], count) if best else (None, None, None, 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, license (best template or null), dice, unit (0: whole text, else line number), n_units (that reach the threshold).

    All within the row: nothing is shuffled and a task holds one text's
    bigrams at a time.
    """
    scanner = Scanner(templates or TEMPLATES, threshold)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    types = [pa.string(), pa.float64(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "license", "dice", "unit", "n_units"])

    return rows.mapInArrow(run, f"doc_id {kind}, license string, dice double, unit int, n_units bigint")
