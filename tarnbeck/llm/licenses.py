"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are runs of letters and digits, lower-cased A-Z. The templates' GRAM-word windows are winnowed (the smallest hash
of each WINDOW neighbours) into an inverted index, those of templates below SHORT words all of them, and with a name or
a number in it every pair of words as well. Texts are looked up window by window, so nothing is left to chance there.
Hits on nearby diagonals make a candidate; its words are aligned with the template's within BAND words of the
diagonal. A match covers at least `least` of the template, and the names and numbers in its span (NAMES and words of
digits) are exactly the template's: one other version, name or clause (NC, SA, ND) is another license. Of
overlapping matches the one with the most matched words stays. Templates and index are of fixed size; texts are read
whole. Only these notices and grants are known, not the bodies of the licenses.

Null and empty texts match nothing and give no row; repeated rows are scanned each; extra columns fall away.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import blocks, only
from tarnbeck.llm.grams import _STEP, FOLDED, mix, prefix, span_hash

GRAM, WINDOW, BAND, LEAST = 3, 2, 8, (80, 100)
#: Notices and grants by which licenses are known.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL": "Released under the GPL License",
    "BSD": "Released under the BSD License",
    "MPL-2.0-short": "Licensed under the Mozilla Public License, Version 2.0",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "All-rights-reserved": "All rights reserved",
}
#: Names and clauses that tell licenses apart.
NAMES = "apache mit gpl lgpl agpl gnu lesser affero mozilla mpl bsd isc cc cc0 nc sa nd creative commons attribution sharealike noncommercial noderivatives noderivs unencumbered".split()
#: Templates of fewer words have all their windows in the index.
SHORT = 12
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and per text the range of its words."""
    n = len(buf)
    inside = _INSIDE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
    end = np.flatnonzero(inside & (~after[1:] | cut[1:])) + 1
    return start, end, span_hash(prefix(buf, FOLDED), start, end), np.searchsorted(start, offs)


def grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    n = len(h) - size + 1
    return mix(sum(h[j : j + n] * _STEP[j] for j in range(size)) + np.uint64(size)) if n > 0 else np.zeros(0, np.uint64)


def winnow(g: np.ndarray) -> np.ndarray:
    """Places of the smallest of each WINDOW neighbours."""
    if len(g) <= WINDOW:
        return np.arange(len(g))
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _hashes(text: str) -> tuple[np.ndarray, list[bool]]:
    """Hashes of a template's words, and which of them are names or numbers."""
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end, h, _ = words(raw, np.array([0, len(raw)]))
    own = [raw[a:b].tobytes().decode().lower() for a, b in zip(start, end)]
    return h, [w in NAMES or w.isdigit() for w in own]


class Index:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names, self.words, self.telling = list(templates), [], []
        self.rows = {GRAM: defaultdict(list), 2: defaultdict(list)}
        names = np.unique(_hashes(" ".join(NAMES))[0])
        for k, text in enumerate(templates.values()):
            h, tells = _hashes(text)
            self.words.append(h)
            self.telling.append([int(x) for x, t in zip(h, tells) if t])
            g = grams(h)
            for p in range(len(g)) if len(h) < SHORT else winnow(g).tolist():
                self.rows[GRAM][int(g[p])].append((k, p))
            if len(h) < SHORT:
                for p, x in enumerate(grams(h, 2).tolist()):
                    if tells[p] or tells[p + 1]:
                        self.rows[2][x].append((k, p))
        self.keys = {size: np.array(sorted(rows), np.uint64) for size, rows in self.rows.items()}
        self.tell = names

    def hits(self, h: np.ndarray):
        """(place, template, place in it) of every window of the words h that is in the index."""
        for size, keys in self.keys.items():
            g = grams(h, size)
            for p in np.flatnonzero(np.isin(g, keys)).tolist():
                for k, q in self.rows[size][int(g[p])]:
                    yield p, k, q


def align(a: list[int], b: list[int], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end in b) of the longest common subsequence of template a and text b, where word i of a
    may only meet words shift + i - band to shift + i + band of b; of equally long ones the one that ends, then
    starts, most tightly."""
    best = {}
    row: dict[int, tuple[int, int, int]] = {}
    for i, x in enumerate(a):
        new: dict[int, tuple[int, int, int]] = {}
        left = (0, 0, 0)
        for j in range(max(0, shift + i - band), min(len(b), shift + i + band + 1)):
            up, diagonal = row.get(j, (0, 0, 0)), row.get(j - 1, (0, 0, 0))
            own = max(up, left)
            if b[j] == x:
                own = max(own, (diagonal[0] + 1, diagonal[1] if diagonal[0] else -j, -j - 1))
            new[j] = left = own
        row = new
    best = max(row.values(), default=(0, 0, 0))
    return best[0], -best[1], -best[2]


def matches(h: np.ndarray, tells: np.ndarray, index: Index, least: tuple[int, int] = LEAST) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, word after the last) of each match in a text's word hashes, by place; tells:
    which words are names or numbers."""
    near: dict[int, set[int]] = defaultdict(set)
    for p, k, q in index.hits(h):
        near[k].add(p - q)
    found = []
    for k, shifts in near.items():
        template, done = index.words[k], None
        for shift in sorted(shifts):
            if done is not None and shift <= done:
                continue
            lo = max(0, shift - BAND)
            part = h[lo : max(0, shift + len(template) + BAND)].tolist()
            n, first, end = align(template.tolist(), part, shift - lo)
            first, end = lo + first, lo + end
            if n * least[1] >= len(template) * least[0] and [int(x) for x, t in zip(h[first:end], tells[first:end]) if t] == index.telling[k]:
                found.append((k, n, first, end))
                done = end - 1
    kept: list[tuple[int, int, int, int]] = []
    for m in sorted(found, key=lambda m: (-m[1], len(index.words[m[0]]), m[2], m[0])):
        if all(m[3] <= x[2] or m[2] >= x[3] for x in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[2], m[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, license, n_matched, n_template (words), start_byte, end_byte of every match in every row of docs."""
    texts = templates or TEMPLATES
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), *[(n, pa.int64()) for n in ("n_matched", "n_template", "start_byte", "end_byte")]])

    def scan(batches):
        index = Index(texts)
        for b in batches:
            ids, rows = b.column("doc_id"), []
            for i, j, buf, offs in blocks(b.column("text")):
                start, end, h, at = words(buf, offs)
                if not len(h):
                    continue
                hit = np.concatenate([np.flatnonzero(np.isin(grams(h, size), keys)) for size, keys in index.keys.items()])  # also across texts; only says which texts to look at
                for d in np.unique(np.searchsorted(at, hit, "right") - 1).tolist():
                    own = slice(at[d], at[d + 1])
                    digits = np.array([not buf[x:y][(buf[x:y] < 48) | (buf[x:y] > 57)].size for x, y in zip(start[own], end[own])], bool)
                    for k, n, x, y in matches(h[own], digits | np.isin(h[own], index.tell), index, least):
                        rows.append((ids[i + d].as_py(), index.names[k], n, len(index.words[k]), int(start[at[d] + x] - offs[d]), int(end[at[d] + y - 1] - offs[d])))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "doc_id long, license string, n_matched long, n_template long, start_byte long, end_byte long")
