"""License scan by conditional compression.

Blocks that may hold license wording are found by cue words: a block is every
cue with as many words on both sides as the longest license may have, and what
overlaps is one block. Templates of which the block has enough words are
aligned word by word with it (whole template, any part of the block). A
template is confirmed if at most ``EDITS`` of its words are missing, added or
replaced and no word with a digit is (another version is another license).
The words confirmed are compressed alone and with the template as a zstandard
raw dictionary, which must save at least ``SAVES`` of what they or the template
take alone. Of confirmed places that overlap, the one with the smaller part
of differing words stays, then the one that saves more. Every place of a
template counts; what is left between the places taken is aligned again until
nothing more is confirmed.

Each row is judged on its own, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quern.storage import table

CUES = r"licen[sc]|copyright|permission\W+is\W+hereby|redistribut|warrant|rights\W+reserved|public\W+domain|as\W+is"
SAVES, LEAST_SAVED = 0.4, 8
EDITS = 0.15
WINDOW = 4_096  #: words aligned together; windows share as many as the longest license may have

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: (license, template)
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY}"""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]

_CUE = re.compile(CUES, re.I)
_WORD = re.compile(r"\w+(?:\.\w+)*")


def blocks(text: str, words: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """First and end word of every candidate block: a cue and ``reach`` words on both sides. ``words``: start and end of each."""
    run: tuple[int, int] | None = None
    for at in np.searchsorted(words[:, 0], np.array([m.start() for m in _CUE.finditer(text)], np.int64), "right").tolist():
        a, z = max(0, at - 1 - reach), min(len(words), at + reach)
        if run and a > run[1]:
            yield run
            run = None
        run = (run[0] if run else a, z)
    if run:
        yield run


def _plain(text: str) -> bytes:
    """The words alone: line breaks, comment marks and punctuation are no difference."""
    return " ".join(_WORD.findall(text.lower())).encode()


def _compressor(dictionary: bytes | None = None) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(level=9, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)


def _distances(template: list[str], block: list[str]) -> np.ndarray:
    """``d[i, j]``: least edits from the first i words of the template to any part of the block that ends at j."""
    m, n = len(template), len(block)
    names = {w: i for i, w in enumerate(dict.fromkeys(template + block))}
    a, b = np.array([names[w] for w in template], np.int64), np.array([names[w] for w in block], np.int64)
    d = np.zeros((m + 1, n + 1), np.int32)
    ramp = np.arange(n + 1)
    for i in range(1, m + 1):
        row = d[i - 1] + 1
        row[1:] = np.minimum(row[1:], d[i - 1, :-1] + (b != a[i - 1]))
        d[i] = np.minimum.accumulate(row - ramp) + ramp
    return d


def _traced(d: np.ndarray, template: list[str], block: list[str], end: int) -> tuple[int, int, list[str], list[str]]:
    i, j, missing, extra = len(template), end, [], []
    while i:
        if j and d[i, j] == d[i - 1, j - 1] + (template[i - 1] != block[j - 1]):
            i, j = i - 1, j - 1
            if template[i] != block[j]:
                missing.append(template[i])
                extra.append(block[j])
        elif d[i, j] == d[i - 1, j] + 1:
            i -= 1
            missing.append(template[i])
        else:
            j -= 1
            extra.append(block[j])
    return j, end, missing[::-1], extra[::-1]


def differences(template: list[str], block: list[str]) -> tuple[int, int, list[str], list[str]]:
    """``(first, end, missing, extra)``: the part of the block nearest to the whole template, the template's words that it lacks and its words that the template lacks (a replaced word counts as both). Of equally near parts the one that ends first; substitutions before other edits."""
    d = _distances(template, block)
    return _traced(d, template, block, int(d[-1].argmin()))


def places(template: list[str], block: list[str]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """``differences`` at every part of the block that confirms the template and doesn't overlap a nearer one."""
    most = EDITS * len(template)
    d = _distances(template, block)
    ends = np.flatnonzero(d[-1] <= 2 * most)
    free = np.ones(len(block), bool)
    for end in ends[np.lexsort((ends, d[-1][ends]))].tolist():
        if end and free[end - 1]:
            first, _, missing, extra = _traced(d, template, block, end)
            if first < end and max(len(missing), len(extra)) <= most and free[first:end].all() and not any(c.isdigit() for w in missing + extra for c in w):
                free[first:end] = False
                yield first, end, missing, extra


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [(name, [m.group().lower() for m in _WORD.finditer(t)], len(_compressor().compress(_plain(t))), _compressor(_plain(t))) for name, t in templates]
        self.alone = _compressor()
        self.counts = [Counter(words) for _, words, _, _ in self.templates]
        self.reach = int(max((len(words) for _, words, _, _ in self.templates), default=0) * (1 + EDITS))

    def ranked(self, block: str, among: Iterable[int] | None = None) -> list[tuple[int, int]]:
        """``(saved bytes, template)``, the most first, of the templates (all, or those ``among``) that save enough."""
        data = _plain(block)
        size = len(self.alone.compress(data))
        saved = [(size - len(self.templates[k][3].compress(data)), k) for k in (range(len(self.templates)) if among is None else among)]
        return sorted(((s, k) for s, k in saved if s >= max(LEAST_SAVED, SAVES * min(size, self.templates[k][2]))), key=lambda x: (-x[0], x[1]))

    def _taken(self, words: list[str]) -> list[tuple[int, int, int, int, list[str], list[str]]]:
        """``(first, end, template, saved, missing, extra)`` of the confirmed places that stay, in order; there may be more between them."""
        confirmed, window = [], max(WINDOW, 2 * self.reach)
        for w in range(0, max(1, len(words) - self.reach), window - self.reach):
            part = words[w : w + window]
            there = Counter(part)
            for k, (_, template, _, _) in enumerate(self.templates):
                if sum((self.counts[k] - there).values()) > EDITS * len(template):
                    continue
                for first, end, missing, extra in places(template, part):
                    for saved, _ in self.ranked(" ".join(part[first:end]), [k]):
                        confirmed.append((max(len(missing), len(extra)) / len(template), -saved, k, w + first, w + end, missing, extra))
        taken = []
        free = np.ones(len(words), bool)
        for _, saved, k, first, end, missing, extra in sorted(confirmed, key=lambda x: x[:5]):
            if free[first:end].all():
                free[first:end] = False
                taken.append((first, end, k, -saved, missing, extra))
        return sorted(taken)

    def scan(self, text: str) -> Iterator[tuple[int, int, str, int, list[str], list[str]]]:
        """``(start, end, license, saved, missing, extra)`` of every confirmed license."""
        spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
        for block in blocks(text, spans, self.reach):
            stretches = [block]
            while stretches:
                a, z = stretches.pop()
                found = spans[a:z].tolist()
                taken = self._taken([text[s:e].lower() for s, e in found])
                for first, end, k, saved, missing, extra in taken:
                    yield found[first][0], found[end - 1][1], self.templates[k][0], saved, missing, extra
                if taken:
                    left = zip([0, *(x[1] for x in taken)], [*(x[0] for x in taken), z - a])
                    stretches += [(a + lo, a + hi) for lo, hi in left if lo < hi]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``(doc_id, start, end, license, saved, missing, extra)``, one row per place of a confirmed license of every row of ``docs``.

    ``start`` and ``end`` count code points. Null and empty texts have no license; a null or repeated doc_id is
    passed through; without rows or templates the result is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.int64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])
        for b in batches:
            b = b.filter(pc.match_substring_regex(b.column("text"), CUES, ignore_case=True))  # a null is dropped
            rows = [(i, *x) for i, t in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), b.column("text")) for x in scanner.scan(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)] if rows else [pa.array([], k) for k in kinds.types], schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, license string, saved long, missing array<string>, extra array<string>")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a license in every document, by the production templates, as :func:`scan` gives them."""
    return scan(table(spark, sf_dir, "documents"))
