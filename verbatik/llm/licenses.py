"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's statements are compared with templates: its lines, their sentences, its windows of as many
words as a template has (also over line breaks), and the whole of a licence file. Of the templates that
fit a statement of the file the one with the greatest product of similarity and root of length names its
licence. Document frequencies are counted over all files: exactly for the templates' terms, in a sketch of
fixed size for all others. A file without a statement of its own
takes the licence of the nearest ancestor directory that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatik.llm.common import materialize

#: Cosine from which a statement is taken for a template's.
THRESHOLD = 0.6
#: Names of licence files, lower-cased, up to a suffix.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
#: Statements by which files and licence files name their licence. Where several fit, a longer
#: one weighs more (similarity times the root of its length), so a clause that only one licence has stands for it.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
)
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
#: The sketch of document frequencies: rows, and counts in a row.
SKETCH_ROWS, SKETCH_WIDTH = 2, 1 << 17
#: Windows whose cosine, and words whose hash, a worker remembers.
CACHE_WINDOWS = 100_000
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def terms(text: str) -> Counter:
    """Words and pairs of neighbouring words, lower-cased."""
    return _terms(_WORD.findall(text.lower()))


def _terms(w) -> Counter:
    return Counter(w) + Counter(zip(w, w[1:], strict=False))


#: Words of each template.
LENGTHS = tuple(len(_WORD.findall(s.lower())) for _, s in TEMPLATES)
VOCABULARY = frozenset(t for _, s in TEMPLATES for t in terms(s))


_MASK = (1 << 64) - 1
_K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w.encode())


def _buckets(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Places of hashed terms in a row of the sketch."""
    h = (h ^ np.uint64(_K[row])) * np.uint64(_K[2])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_K[0])
    return (h >> np.uint64(33)).astype(np.int64) % width


def _pair_hashes(a, b):
    return a * np.uint64(_K[0]) + b * np.uint64(_K[1])


class Scanner:
    """Templates as unit TF-IDF vectors under the corpus' document frequencies.

    The templates' terms are counted exactly (frequency), all others in a sketch of fixed size: rows of
    counts by hash, of which the least is taken. So a term has at least its own frequency, and terms
    rarer than the sketch tells apart have about the same idf.
    """

    def __init__(self, files: int, frequency: dict, sketch: np.ndarray):
        self.files, self.frequency, self.sketch = files, frequency, sketch
        self.known: dict = {}

    def idf(self, term) -> float:
        found = self.known.get(term)
        if found is None:
            n = self.frequency.get(term)
            if n is None:
                h = np.array([_word_hash(w) for w in ([term] if isinstance(term, str) else term)], np.uint64)
                h = h if len(h) == 1 else _pair_hashes(h[:1], h[1:])
                n = min(int(row[_buckets(h, r, len(row))[0]]) for r, row in enumerate(self.sketch))
            if len(self.known) >= CACHE_WINDOWS:
                self.known.clear()
            found = self.known[term] = math.log((1 + self.files) / (1 + min(n, self.files))) + 1
        return found

    def vector(self, text: str) -> dict:
        return self._unit(terms(text))

    def _unit(self, counts: Counter) -> dict:
        v = {t: n * self.idf(t) for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def prepared(self):
        vectors = [(name, self.vector(s)) for name, s in TEMPLATES]
        # words without which no cosine can reach the threshold: the others' share of each template is too small
        words = sorted({t for _, v in vectors for t in v if isinstance(t, str)}, key=self.idf)
        common: set = set()
        for w in words:
            rest = common | {w}
            if any(sum(x * x for t, x in v.items() if (t in rest if isinstance(t, str) else rest.issuperset(t))) >= THRESHOLD**2 for _, v in vectors):
                continue
            common = rest
        return vectors, frozenset(words) - common

    def statements(self, low: str, whole: bool, vectors, wanted) -> tuple[list[str], list[tuple[int, tuple[str, ...]]]]:
        """Of a lower-cased text: parts to compare with all templates, and windows with the number of the template of their length.

        The sieve: a part, or a window, without a wanted word (of its template) can't reach the threshold.
        """
        w = _WORD.findall(low)
        at = [i for i, x in enumerate(w) if x in wanted]
        if not at:
            return [], []
        lines = [x for x in low.split("\n") if not wanted.isdisjoint(_WORD.findall(x))]
        parts = lines + [p for x in lines for p in _SENTENCE.split(x) if p != x and not wanted.isdisjoint(_WORD.findall(p))] + ([low] if whole else [])
        windows = []
        for k, (_, v) in enumerate(vectors):
            n = LENGTHS[k]
            starts = {i for p in at if w[p] in v for i in range(max(0, p - n + 1), max(0, min(p, len(w) - n)) + 1)}
            windows += [(k, tuple(w[i : i + n])) for i in starts]
        return parts, windows

    def license(self, low: str, whole: bool, vectors, wanted, cache: dict) -> tuple[str | None, float]:
        """The licence of a lower-cased text, and its similarity."""
        parts, windows = self.statements(low, whole, vectors, wanted)
        found: list[tuple[float, float, str | None]] = [(0.0, 0.0, None)]
        for x in parts:
            v = self.vector(x)
            found += [(weight(cos, k), cos, name) for k, (name, u) in enumerate(vectors) if (cos := _cosine(v, u)) >= THRESHOLD]
        for k, window in windows:
            if (cos := cache.get((k, window))) is None:
                if len(cache) >= CACHE_WINDOWS:
                    cache.clear()
                cos = cache[k, window] = _cosine(self._unit(_terms(window)), vectors[k][1])
            if cos >= THRESHOLD:
                found.append((weight(cos, k), cos, vectors[k][0]))
        _, cos, name = max(found, key=lambda f: (f[0], f[1], f[2] or ""))
        return name, cos


def weight(cos: float, k: int) -> float:
    """How much a statement as similar to template k tells."""
    return round(cos, 9) * math.sqrt(LENGTHS[k])


def _cosine(v: dict, u: dict) -> float:
    if len(u) < len(v):
        u, v = v, u
    return min(1.0, sum(x * u.get(t, 0.0) for t, x in v.items()))


def fit(files: DataFrame, text_col: str = "text", width: int = SKETCH_WIDTH) -> Scanner:
    """Document frequencies of all terms of all files; what is collected is of fixed size."""
    words_ = frozenset(t for t in VOCABULARY if isinstance(t, str))
    pairs_ = VOCABULARY - words_

    def run(batches):
        exact: Counter = Counter()
        sketch, waiting, size, files_ = np.zeros((SKETCH_ROWS, width), np.int64), [], 0, 0
        known: dict[str, int] = {}

        def settle():
            h = np.concatenate(waiting)
            for r in range(SKETCH_ROWS):
                sketch[r] += np.bincount(_buckets(h, r, width), minlength=width)
            waiting.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                w = _WORD.findall((text or "").lower())
                if not w:
                    continue
                files_ += 1
                exact.update(words_.intersection(w))
                exact.update(pairs_.intersection(zip(w, w[1:], strict=False)))
                for x in set(w):
                    if x not in known:
                        known[x] = _word_hash(x)
                h = np.array([known[x] for x in w], np.uint64)
                waiting.append(np.unique(np.concatenate((h, _pair_hashes(h[:-1], h[1:])))))
                size += len(waiting[-1])
                if size > 1_000_000:
                    settle()
                    size = 0
                if len(known) > CACHE_WINDOWS:
                    known.clear()
        if waiting:
            settle()
        rows = [("", -1, files_), *((t if isinstance(t, str) else " ".join(t), -1, n) for t, n in exact.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["term", "place", "n"])
        for r in range(SKETCH_ROWS):
            at = np.flatnonzero(sketch[r])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at + r * width, pa.int32()), pa.array(sketch[r][at])], ["term", "place", "n"])

    counts = files.select(F.col(text_col).alias("t")).mapInArrow(run, "term string, place int, n bigint").groupBy("term", "place").agg(F.sum("n").alias("n")).toArrow()
    place, n = np.array(counts.column("place")), np.array(counts.column("n"))
    sketch = np.zeros(SKETCH_ROWS * width, np.int64)
    sketch[place[place >= 0]] = n[place >= 0]
    exact = {t: int(x) for t, x in zip(counts.column("term").to_pylist(), n, strict=True) if t is not None}
    files_ = exact.pop("", 0)
    frequency = dict.fromkeys(VOCABULARY, 0) | {tuple(t.split(" ")) if " " in t else t: x for t, x in exact.items()}
    return Scanner(files_, frequency, sketch.reshape(SKETCH_ROWS, width))


def scan(files: DataFrame, scanner: Scanner, path_col: str = "path", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """path, the carried columns, dir, is_license_file, own_license, similarity for every file."""
    cols = [F.col(path_col).alias("path"), F.col(text_col).alias("_t"), *carry]
    rows = files.select(*cols).withColumn("_name", F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1))
    rows = rows.withColumn("is_license_file", F.col("_name").rlike(LICENSE_FILE))
    shared = files.sparkSession.sparkContext.broadcast(scanner)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("path", *carry, "is_license_file").schema)

    def run(batches):
        scanner = shared.value
        (vectors, wanted), cache = scanner.prepared(), {}
        for b in batches:
            names, sims = [], []
            for text, whole in zip(b.column("_t").to_pylist(), b.column("is_license_file").to_pylist(), strict=True):
                best = scanner.license((text or "").lower(), whole, vectors, wanted, cache)
                names.append(best[0])
                sims.append(best[1])
            keep = ["path", *carry, "is_license_file"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(sims, pa.float64())], [*keep, "own_license", "similarity"])

    out = rows.mapInArrow(run, f"{kinds}, own_license string, similarity double")
    return out.withColumn("dir", F.regexp_replace(F.coalesce("path", F.lit("")), r"/?[^/]*$", ""))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license (own, or the nearest ancestor directory's) and inherited_from (that directory).

    A directory's licence is that of its licence file of the greatest similarity, then the first by
    path. Ancestors are joined once for each directory, not for each file, so the many files below
    one directory don't meet in the join; its result is joined to files by directory.
    """
    files = scanned.where(F.col("is_license_file") & F.col("own_license").isNotNull())
    first = F.min_by("own_license", F.struct(-F.col("similarity"), F.col("path"), F.col("own_license")))
    held = files.groupBy(F.col("dir").alias("anc")).agg(first.alias("l"))
    dirs = scanned.select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    depth = dirs.select("dir", F.posexplode(up).alias("depth", "anc")).join(held, "anc")
    near = depth.groupBy("dir").agg(F.max_by("l", "depth").alias("dir_license"), F.max_by("anc", "depth").alias("anc"))
    out = scanned.join(near, "dir", "left")
    inherits = F.col("own_license").isNull()
    out = out.withColumn("license", F.coalesce("own_license", "dir_license"))
    return out.withColumn("inherited_from", F.when(inherits, F.col("anc"))).drop("dir_license", "anc")


def scan_tree(files: DataFrame, path_col: str = "path", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """path, carried columns, is_license_file, own_license, similarity, license, inherited_from for every file.

    Null and empty texts have no licence of their own. A null path has no directory but the root.
    Files of the same path are judged each; ties of weight go to the greater similarity, then to
    the last name. Very long texts
    are searched whole. Other columns are ignored; an empty table gives an empty result.
    """
    # the scan's narrow result is read three times
    return inherit(materialize(scan(files, fit(files, text_col), path_col, text_col, carry), "licenses")).drop("dir")
