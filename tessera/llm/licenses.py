"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is scanned in segments: each of its lines and, if it has several lines
with words, the text as a whole.  Segments and templates are normalised to
lower-case words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and compared as sets
of word bigrams A and B by 2 |A and B| / (|A| + |B|).  A Dice of t needs
t / (2 - t) |B| <= |A| <= (2 - t) / t |B|, so a segment is only compared with
templates whose size lies within these bounds; most lines have none.

Everything runs in the scan partition.  Templates are a parameter, a short
list.  Null or empty texts and segments of fewer than two words match nothing;
ties go to the smaller template name, then the earlier line; rows are treated
one by one; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, ngrams, slices, utf8, words
from .tables import ready

DICE = 0.8

# Short notices by which works name their licence.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General "
                 "Public License, version 2.1."),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def bigram_sets(templates) -> tuple[list[str], list[np.ndarray]]:
    names, sets = [], []
    for name, text in sorted(templates):
        data, off = utf8(pa.array([text], pa.string()))
        s = np.unique(ngrams(words(data, off, ALNUM)[0], 2))
        if len(s):
            names.append(name)
            sets.append(s)
    return names, sets


def scan_licenses(docs: DataFrame, templates=TEMPLATES, dice: float = DICE, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_segments (with two words or more) and
    ``licenses``, every match as (license, dice, line), line -1 for the whole
    text, best first."""
    if not 0 < dice <= 1:
        raise ValueError("0 < dice <= 1")
    ready(docs.sparkSession)
    names, sets = bigram_sets(templates)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    match = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("line", pa.int64())])

    def segments(h, doc_of, line_of):
        """(segment's document, line, bigram) rows, distinct within a segment."""
        for line in (line_of, np.full(len(line_of), -1, np.int64)):
            gram = ngrams(h, 2)
            same = (doc_of[1:] == doc_of[:-1]) & (line[1:] == line[:-1])
            d, n, g = doc_of[:-1][same], line[:-1][same], gram[same] if len(gram) else gram
            order = np.lexsort((g, n, d))
            d, n, g = d[order], n[order], g[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (n[1:] != n[:-1]) | (g[1:] != g[:-1])
            yield d[new], n[new], g[new]

    def scan(batches):
        for b in slices(batches, 1):
            data, off = utf8(b.column(1))
            h, woff, ws, _ = words(data, off, ALNUM, spans=True)
            breaks = np.flatnonzero(data == 10)
            doc_of = np.repeat(np.arange(len(off) - 1), np.diff(woff))
            line_of = np.searchsorted(breaks, ws) - np.searchsorted(breaks, off[:-1])[doc_of]
            found, count = [[] for _ in range(len(off) - 1)], np.zeros(len(off) - 1, np.int64)
            lines_seen = None
            for d, n, g in segments(h, doc_of, line_of):
                if not len(d):
                    continue
                head = np.ones(len(d), bool)
                head[1:] = (d[1:] != d[:-1]) | (n[1:] != n[:-1])
                first = np.flatnonzero(head)
                size = np.diff(np.append(first, len(d)))
                seg = np.cumsum(head) - 1
                sd, sn = d[first], n[first]
                if lines_seen is None:                      # the whole text counts beside several lines
                    lines_seen = np.zeros(len(off) - 1, np.int64)
                    pairs = np.unique(np.stack([doc_of, line_of], axis=1), axis=0)
                    lines_seen += np.bincount(pairs[:, 0], minlength=len(off) - 1)
                    use = np.ones(len(sd), bool)
                else:
                    use = lines_seen[sd] > 1
                count += np.bincount(sd[use], minlength=len(off) - 1)
                for name, t in zip(names, sets):
                    fits = use & (size * (2 - dice) >= dice * len(t) - 1e-9) & (size * dice <= (2 - dice) * len(t) + 1e-9)
                    if not fits.any():
                        continue
                    at = np.flatnonzero(fits[seg])
                    both = np.bincount(seg[at][np.isin(g[at], t)], minlength=len(first))
                    score = 2.0 * both / (size + len(t))
                    for k in np.flatnonzero(fits & (score >= dice)).tolist():
                        found[sd[k]].append((-float(score[k]), name, int(sn[k])))
            out = [[{"license": m, "dice": -s, "line": k} for s, m, k in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(out, pa.list_(match))],
                                             names=["doc_id", "n_segments", "licenses"])

    return slim.mapInArrow(scan, f"doc_id {id_type}, n_segments long, "
                                 "licenses array<struct<license: string, dice: double, line: long>>")
