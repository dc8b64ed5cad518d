"""License scans: word fingerprints of templates and banded alignment.

The words of the templates (a bounded set, shipped with the plan) are kept in
an inverted index (hash -> template, position).  Every word of a whole document
is looked up.  A match of m words has m hits on diagonals no further apart than
the band, so each diagonal with as many hits around it as the accepted coverage
asks for is a candidate, and no match of that coverage is left out however its
words are changed.  A banded alignment of the template with that stretch of the
document confirms it, reporting matched coverage and the span.

Edge cases: a template without a word is refused; null or empty text matches nothing; an empty table gives an empty
result; repeated rows and several matches in a text each give a row;
overlapping matches of one template are reduced to the best (first on ties);
extra columns are not read."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memscan.llm import common

MIN_COVERAGE = 0.8

#: Notices as published by their stewards.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions: The above copyright notice and this permission notice shall be included in all "
           "copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met: Redistributions of source code must retain the above copyright "
           "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
           "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
           "documentation and/or other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                  "in compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation, either version 3 of the License, "
               "or (at your option) any later version.",
    "lgpl-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "Lesser General Public License as published by the Free Software Foundation; either version 3 of the "
                "License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
               "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                 "modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
                 "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: words are runs of ASCII letters and digits and of bytes beyond ASCII
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(buf: np.ndarray, off: np.ndarray):
    """(hash, start, end, words per row) of all words, ASCII case folded."""
    starts, ends, n = common.word_spans(buf, off, SEPARATOR)
    return common.span_hashes(common.LOWER[buf], starts, ends), starts, ends, n


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.tok, rows = [], []
        for t, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            h, *_ = tokens(raw, np.array([0, len(raw)]))
            self.tok.append(h)
            if not len(h):
                raise ValueError(f"template without a word: {name}")
            rows += [(x, t, p) for p, x in enumerate(h)]
        rows.sort(key=lambda r: r[0])
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.position = np.array([r[2] for r in rows], np.int64)

        self.words = np.array([len(h) for h in self.tok], np.int64)
        # diagonals on either side of a start; less than the template, so that copies side by side stay apart
        self.band = np.minimum(2 * np.maximum(2, self.words // 8), np.maximum(self.words - 1, 0))

    def hits(self, g: np.ndarray):
        """(position in g, template, position in template) of all index hits."""
        lo = np.searchsorted(self.hash, g, side="left")
        n = np.searchsorted(self.hash, g, side="right") - lo
        at = np.flatnonzero(n)
        n = n[at]
        pos = np.repeat(at, n)
        head = np.cumsum(n) - n
        k = np.repeat(lo[at], n) + np.arange(len(pos)) - np.repeat(head, n)
        return pos, self.template[k], self.position[k]


def align(template: np.ndarray, doc: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """Best alignment of the whole template with doc near ``start`` within
    ``band`` diagonals: (matched words, first, last + 1 position in doc).

    Match +2, anything else -1, free ends in the document."""
    width = 2 * band + 1
    d = np.arange(width)
    low = -10 ** 6
    score = np.zeros(width, np.int64)
    back = np.zeros((len(template) + 1, width), np.int8)
    for i, t in enumerate(template):
        j = start + i + d - band                       # document position of column d
        inside = (j >= 0) & (j < len(doc))
        same = np.zeros(width, bool)
        same[inside] = doc[j[inside]] == t
        step = np.where(inside, score + np.where(same, 2, -1), low)
        up = np.append(score[1:], low) - 1             # template word left out
        x = np.maximum(step, up)
        run = np.maximum.accumulate(x + d) - d         # document words left out
        back[i + 1] = np.where(run > x, 3, np.where(step >= up, np.where(same, 1, 2), 4))
        score = run
    c = int(score.argmax())
    i, matched, first, last = len(template), 0, -1, -1
    while i > 0:
        m = back[i, c]
        if m == 3:
            c -= 1
            continue
        if m == 1:
            j = start + (i - 1) + c - band
            matched += 1
            first, last = j, j if last < 0 else last
        c += m == 4
        i -= 1
    return matched, first, last + 1


def candidates(index: Index, h: np.ndarray, n: np.ndarray, min_coverage: float = MIN_COVERAGE):
    """(row, template, start in the row) of all diagonals that have enough hits
    within the band, sorted.  h: words of all rows; n: words per row."""
    pos, tmpl, tpos = index.hits(h)
    if not len(pos):
        return (np.zeros(0, np.int64),) * 3
    first = np.cumsum(n) - n
    # rows that have enough different words of a template at all
    row = np.repeat(np.arange(len(n)), n)[pos]
    group = row * len(index.names) + tmpl
    most = int(index.words.max())
    some, different = np.unique(np.unique(group * most + tpos) // most, return_counts=True)
    keep = np.isin(group, some[different >= min_coverage * index.words[some % len(index.names)]])
    pos, tpos, row, group = pos[keep], tpos[keep], row[keep], group[keep]
    if not len(pos):
        return (np.zeros(0, np.int64),) * 3
    first = np.cumsum(n) - n
    margin = int(most + 2 * index.band.max() + 1)
    span = int(n.max()) + 2 * margin                   # windows of two groups never touch
    key = group * span + (pos - first[row] - tpos + margin)
    order = np.argsort(key, kind="stable")
    key, tpos = key[order], tpos[order]
    band = index.band[key // span % len(index.names)]
    need = min_coverage * index.words[key // span % len(index.names)]
    lo, hi = np.searchsorted(key, key - band), np.searchsorted(key, key + band, side="right")
    at = np.flatnonzero((hi - lo >= need) & np.append(True, key[1:] != key[:-1]))
    key = key[at[[len(np.unique(tpos[lo[i]:hi[i]])) >= need[i] for i in at]]] if len(at) else key[:0]
    return key // span // len(index.names), key // span % len(index.names), key % span - margin


def scan_tokens(index: Index, h: np.ndarray, tmpl: np.ndarray, starts: np.ndarray, min_coverage: float = MIN_COVERAGE):
    """[(template, matched, first, last + 1)] of one document's words."""
    out = []
    for t in np.unique(tmpl):
        words = index.tok[t]
        found = []
        for s in starts[tmpl == t]:
            matched, a, b = align(words, h, int(s), int(index.band[t]))
            if matched >= min_coverage * len(words):
                found.append((matched, a, b))
        # best first; the spans taken are disjoint, so only two of them can overlap a new one
        taken: list[tuple[int, int, int]] = []
        for m, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
            k = bisect.bisect_left(taken, (a, b, m))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
                taken.insert(k, (a, b, m))
        out += [(int(t), m, a, b) for a, b, m in taken]
    return out


SCHEMA = ("doc_id long, license string, coverage double, n_matched long, n_template long, "
          "start_byte long, end_byte long, matched_text string")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per match: license, coverage (matched share of the template's
    words), byte span in the UTF-8 text and the text of the span."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(templates)
    cached: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            cached.append(Index(shared.value))
        index = cached[0]
        for b in common.chunks(batches, "text"):
            buf, off = common.text_buffer(b.column("text"))
            h, starts, ends, n = tokens(buf, off)
            row, tmpl, start = candidates(index, h, n, min_coverage)
            first = np.cumsum(n) - n
            rows = np.unique(row)
            ids = b.column("doc_id")
            out = []
            for r in rows:
                lo, hi = first[r], first[r] + n[r]
                at = slice(*np.searchsorted(row, [r, r + 1]))
                for t, m, x, y in scan_tokens(index, h[lo:hi], tmpl[at], start[at], min_coverage):
                    s, e = starts[lo + x], ends[lo + y - 1]
                    out.append((ids[int(r)].as_py(), index.names[t], m / len(index.tok[t]), m, len(index.tok[t]),
                                int(s - off[r]), int(e - off[r]), buf[s:e].tobytes().decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
