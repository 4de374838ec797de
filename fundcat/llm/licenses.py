"""Licence scans: lines, paragraphs and word windows compared with licence templates
by the Dice coefficient over word bigrams. With coefficient t a passage of a bigrams can match a template of b
only if t * (a + b) <= 2 * min(a, b), which rules most templates out by size alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.llm.common import small_batches, table

THRESHOLD = 0.8

#: Notices and opening clauses of public licences, by SPDX name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Bigrams of the normalised words: lower case, letters, digits and versions."""
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.templates = [(name, b) for name, t in templates if (b := bigrams(t))]
        self.all = frozenset().union(*(b for _, b in self.templates))
        #: Common bigrams that a passage needs at least, and its bigrams at most, by template.
        self.bounds = [(name, b, len(b) * threshold / (2 - threshold) - 1e-9, len(b) * (2 - threshold) / threshold + 1e-9) for name, b in self.templates]
        sizes = [len(b) for _, b in self.templates] or [0]
        self.least, self.most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold

    def best(self, passage: str) -> tuple[str, float] | None:
        """The nearest template at or over the threshold; ties go to the first name."""
        own = bigrams(passage)
        if not self.least <= len(own) <= self.most or own.isdisjoint(self.all):
            return None
        found = []
        for name, b in self.templates:
            if self.threshold * (len(own) + len(b)) > 2 * min(len(own), len(b)):
                continue
            dice = 2 * len(own & b) / (len(own) + len(b))
            if dice >= self.threshold:
                found.append((-dice, name))
        return (min(found)[1], -min(found)[0]) if found else None

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Matches ``(license, dice, start, end)`` by character offsets: of a text's
        lines, of its paragraphs of more than one line, and of word windows anywhere in
        it where no line or paragraph that overlaps them matches as well."""
        out: list[tuple[str, float, int, int]] = []
        lower = (text or "").lower()
        words = _WORD.findall(lower)
        pairs = list(zip(words, words[1:], strict=False))
        common = self.all.intersection(pairs)
        near = [x for x in self.bounds if len(common & x[1]) >= x[2]] if common else []
        if not near:  # no passage has bigrams that the text has not
            return out
        at = block = 0
        lines = 0
        for line in [*text.split("\n"), ""]:
            if line.strip():
                lines += 1
                if m := self.best(line):
                    out.append((*m, at, at + len(line)))
            else:
                if lines > 1 and (m := self.best(text[block : max(block, at - 1)])):
                    out.append((*m, block, at - 1))
                block, lines = at + len(line) + 1, 0
            at += len(line) + 1
        whole = list(out)
        for name, dice, start, end in self.windows(pairs, near, [m.span() for m in _WORD.finditer(lower)]):
            if len(lower) != len(text):
                at_lower = [i for i, c in enumerate(text) for _ in c.lower()]
                start, end = at_lower[start], at_lower[end - 1] + 1
            if not any(d >= dice and a < end and start < z for _, d, a, z in whole):
                out.append((name, dice, start, end))
        return sorted(out, key=lambda m: (m[2], m[3]))

    def windows(self, pairs: list, near: list, spans: list) -> list[tuple[str, float, int, int]]:
        """The windows of whole words at or over the threshold, best first, without those
        that overlap a better one. Only windows whose first and last bigram are the
        template's and occur once in them are tried: any other gains or is as good
        without its edge. At most a template's number of starts is open at a word."""
        found = []
        for name, b, _, most in near:
            for i in (i for i, p in enumerate(pairs) if p in b):
                seen: set = set()
                k = 0
                for j in range(i, len(pairs)):
                    p = pairs[j]
                    if p in seen:
                        if p == pairs[i]:
                            break
                        continue
                    seen.add(p)
                    if len(seen) > most:
                        break
                    if p in b:
                        k += 1
                        if (dice := 2 * k / (len(seen) + len(b))) >= self.threshold:
                            found.append((-dice, i, j + 1, name))
        taken: list[tuple[int, int]] = []
        out = []
        for d, i, j, name in sorted(found):
            at = bisect_left(taken, (i, i))
            if (at == 0 or taken[at - 1][1] < i) and (at == len(taken) or taken[at][0] > j):
                insort(taken, (i, j))
                out.append((name, -d, spans[i][0], spans[j][1]))
        return out




def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` -> ``(doc_id, n_matches, license, dice, licenses)``, one row per
    input row: the best match (null if none; ties to the earliest passage) and the
    distinct licences in order. Null and empty texts have no match; repeated rows keep
    their repeats; other columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [scanner.scan(t) for t in b["text"]]
            best = [max(m, key=lambda x: (x[1], -x[2])) if m else None for m in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_matches": [len(m) for m in found], "license": [x and x[0] for x in best], "dice": [x and x[1] for x in best], "licenses": [sorted({x[0] for x in m}) for m in found]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n_matches long, license string, dice double, licenses array<string>")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES: dict[str, str] = {}
