"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Words are lower-cased ASCII letters, digits and other bytes between white space and ASCII punctuation. A template of
five words or more has the set of its 5-word shingles; a shorter one is a single shingle of all its
words. Templates are put on scales: scale ``s`` holds those of more than ``s/2`` and at most ``s``
shingles. On a scale, windows of ``s + s/4`` shingles start every ``s/4``, so that any run of ``s``
shingles lies whole in a window.

A window that holds the fraction ``c = 0.75`` of a template's shingles has a Jaccard similarity to
it of at least ``c*n / (w + (1-c)*n)``, which is 0.27 or more. With bands of one MinHash
value each, 32 bands retrieve such a template with a probability of at least 1 - 0.73**32 = 0.99996
a window; an exact copy (0.4 or more) is missed once in ten million. Retrieved templates
are verified by exact containment, so no false match is reported.

Defined results: a null or empty text has no match; repeated rows give equal results; spans are
counted in the words above, ends exclusive, sorted by start and name; overlapping windows that
match one template make one span. The result has its own columns only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hash_spans, map_texts, mix, text_bytes

WIDTH = 5
CONTAINMENT = 0.75
BANDS = 32

# Notices and permission paragraphs of common licenses, by name.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in [*range(9, 14), *b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]:
    _FOLD[_c] = 32


def folded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and by row the number of its first word (one more than rows)."""
    raw, offsets = text_bytes(column)
    raw = _FOLD[raw]
    edge = np.diff((raw != 32).astype(np.int8), prepend=0)
    start = edge == 1
    inner = offsets[1:-1][offsets[1:-1] < len(raw)]
    start[inner] |= raw[inner] != 32  # a row starts a word of its own
    starts = np.flatnonzero(start)
    stop = np.zeros(len(raw) + 1, dtype=bool)
    stop[:-1] = edge == -1
    if len(raw):
        stop[-1] = raw[-1] != 32
        after = inner[raw[inner - 1] != 32] if len(inner) else inner
        stop[after] = True
    ends = np.flatnonzero(stop)
    return hash_spans(raw, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out)


def _scale(n: int) -> int:
    s = 1
    while s < n:
        s *= 2
    return s


class Templates:
    """The templates' shingle sets and their MinHash bands, by shingle width and scale."""

    def __init__(self, texts: dict[str, str] | None = None, bands: int = BANDS):
        texts = TEMPLATES if texts is None else texts
        self.names = sorted(texts)
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.scales: dict[tuple[int, int], list] = {}
        for number, name in enumerate(self.names):
            words, _ = folded_words(pa.array([texts[name]]))
            width = min(WIDTH, len(words))
            if width:
                found = np.unique(shingles(words, width))
                self.scales.setdefault((width, _scale(len(found))), []).append((number, found))
        self.tables, self.winners = {}, {}
        for key, members in self.scales.items():
            self.tables[key] = np.array([[(s * f).min() for f in self.factors] for _, s in members])
            winners = np.unique([s[(s * f).argmin()] for _, s in members for f in self.factors])
            first = np.zeros(1 << 16, bool)  # by the first 16 bits, to pass over nearly all shingles at once
            first[(winners >> np.uint64(48)).astype(np.int64)] = True
            self.winners[key] = (winners, first)


def _windows(first: np.ndarray, count: np.ndarray, at: np.ndarray, step: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, end)`` of the windows that have one of the shingles ``at``; rows begin at ``first`` and
    windows every ``step`` shingles from there."""
    row = np.searchsorted(first, at, side="right") - 1
    block = (at - first[row]) // step
    # a shingle's block and the ones before it that the window reaches over
    back = np.arange(span)
    row, block = np.repeat(row, span), (block[:, None] - back[None, :]).ravel()
    key = np.unique(np.stack([row, block], axis=1)[block >= 0], axis=0)
    row, block = key[:, 0], key[:, 1]
    start = first[row] + block * step
    return row, start, np.minimum(start + span * step, first[row] + count[row])


def scan_batch(column: pa.Array, templates: Templates, containment: float = CONTAINMENT) -> list[list[tuple[int, int, str, float]]]:
    """By row: ``(start word, end word, template, share of its shingles found)``.

    A window's MinHash value of a band can only equal a template's if the window has the very shingle that is least
    in the template. So the values are computed for windows with such a shingle, which gives the
    same collisions as computing them for all."""
    words, bounds = folded_words(column)
    out: list[list] = [[] for _ in range(len(column))]
    by_width: dict[int, np.ndarray] = {}
    for (width, scale), members in templates.scales.items():
        if width not in by_width:
            by_width[width] = shingles(words, width)
        all_shingles = by_width[width]
        count = np.maximum(0, np.diff(bounds) - width + 1)
        rows = np.flatnonzero(count)
        winners, table = templates.winners[(width, scale)]
        at = np.flatnonzero(table[(all_shingles >> np.uint64(48)).astype(np.int64)])
        at = at[np.isin(all_shingles[at], winners)]
        if not len(at) or not len(rows):
            continue
        # shingles that begin in one row and end in another are none
        place = np.searchsorted(bounds[:-1][rows], at, side="right") - 1
        at = at[at - bounds[:-1][rows][place] < count[rows][place]]
        step = max(1, scale // 4)
        span = scale // step + 1
        row, starts, ends = _windows(bounds[:-1][rows], count[rows], at, step, span)
        mins = templates.tables[(width, scale)]
        for r, a, z in zip(rows[row].tolist(), starts.tolist(), ends.tolist()):
            window = all_shingles[a:z]
            least = (window[None, :] * templates.factors[:, None]).min(axis=1)
            for m in np.flatnonzero((mins == least[None, :]).any(axis=1)).tolist():
                number, own = members[m]
                inside = np.isin(window, own)
                share = len(np.unique(window[inside])) / len(own)
                if share < containment:
                    continue
                found = np.flatnonzero(inside)
                first, last = a + int(found[0]) - int(bounds[r]), a + int(found[-1]) + width - int(bounds[r])
                name = templates.names[number]
                before = next((k for k in range(len(out[r]) - 1, -1, -1) if out[r][k][2] == name), None)
                if before is not None and first < out[r][before][1]:
                    f, e, _, s = out[r][before]
                    out[r][before] = (min(f, first), max(e, last), name, max(s, share))
                else:
                    out[r].append((first, last, name, share))
    return [sorted(x) for x in out]


SCHEMA = "doc_id long, n_matches long, licenses string, spans string"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """One row a document: number of matches, distinct license names, spans as ``name:start:end``."""
    templates = Templates(texts)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan_batch(batch.column(1), templates)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(sorted({m[2] for m in f})) for f in found], pa.string()),
                pa.array([",".join(f"{n}:{a}:{b}" for a, b, n, _ in f) for f in found], pa.string()),
            ],
            ["doc_id", "n_matches", "licenses", "spans"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, work, SCHEMA)
