"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are lower-cased runs of letters and digits; shingles are five words.  A template counts as
present in a window if at least ``similarity`` (0.8) of its distinct shingles are in the window.

Templates are put in classes by size: class L holds templates of more than L/2 and at most L
shingles, and its windows are 2 L shingles wide and L apart, so that every stretch of L shingles
lies whole in some window.  A window that holds 0.8 of a template then has a Jaccard similarity of
at least 0.8 (L/2) / (2 L + 0.2 L) > 0.18 to it.  Signatures have ``BANDS`` (64) bands of one
row: a pair at that similarity shares a band with probability above 1 - (1 - 0.18)^64 > 0.99999.
Candidates are verified by counting the shingles themselves, word by word, so nothing false is reported.

Windows without any word sequence of a template cannot match and are not hashed: only runs of at
least five words that templates hold are looked at.  Templates are few; those of more than
``MOST_WORDS`` words in all are refused, the bound of what is broadcast.

Defined results: null and empty texts match nothing; templates of fewer than five words count as
one shingle of all their words; repeated rows each stand; empty tables give empty results or no matches.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import kept_and, portions

SHINGLE, BANDS, MOST_WORDS = 5, 64, 2_000_000
#: ASCII letters and digits and all bytes of other scripts make words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Wording of common license notices; fixed values.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means.",
}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split() if text else []


def shingle_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


class TemplateIndex:
    """Template shingles by size class, and their banded signatures."""

    def __init__(self, templates: list[tuple[str, str]], similarity: float = 0.8):
        import numpy as np

        self.similarity = similarity
        rng = np.random.default_rng(20240501)
        self.factor = rng.integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)
        self.shift = rng.integers(0, 2**63, BANDS, dtype=np.uint64)
        self.vocabulary: set[bytes] = set()
        self.classes: dict[int, dict] = {}
        self.short: dict[tuple[bytes, ...], list[str]] = {}
        self.known: set[int] = set()
        for name, text in templates:
            words = words_of(text)
            if not words:
                continue
            self.vocabulary.update(words)
            if len(words) < SHINGLE:
                self.short.setdefault(tuple(words), []).append(name)
                continue
            shingles = {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
            own = {xxhash.xxh64_intdigest(x) for x in shingles}
            self.known |= own
            size = 1
            while size < len(own):
                size *= 2
            held = self.classes.setdefault(size, {"sets": [], "bands": {}})
            number = len(held["sets"])
            held["sets"].append((name, own, shingles))
            for band, value in enumerate(self.signature(np.array(sorted(own), np.uint64)).tolist()):
                held["bands"].setdefault((band, value), []).append(number)
        self.least = min([SHINGLE, *map(len, self.short)])

    def signature(self, hashes):
        """The least value of each band's hash function over the shingles."""
        import numpy as np

        mixed = hashes[:, None] * self.factor + self.shift
        mixed ^= mixed >> np.uint64(29)
        return (mixed * self.factor).min(axis=0)

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment) of every match, best span of those that overlap."""
        import numpy as np

        flags = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        places: dict[int, int] = {}
        found: list[tuple[str, int, int, float]] = []
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            for i in range(a, b - SHINGLE + 1):
                h = shingle_hash(words[i : i + SHINGLE])
                if h in self.known:
                    places[i] = h
            for text, names in self.short.items():
                for i in range(a, b - len(text) + 1):
                    if tuple(words[i : i + len(text)]) == text:
                        found += [(name, i, i + len(text), 1.0) for name in names]
        if places:
            last = len(words) - SHINGLE + 1
            held = sorted(places)
            hashes: dict[int, int] = dict(places)
            for size, own in self.classes.items():
                windows = sorted({w for i in held for w in (i // size * size, i // size * size - size) if w >= 0})
                for w in windows:
                    stop = min(last, w + 2 * size)
                    for i in range(w, stop):
                        if i not in hashes:
                            hashes[i] = shingle_hash(words[i : i + SHINGLE])
                    inside = {hashes[i] for i in range(w, stop)}
                    mark = self.signature(np.fromiter(inside, np.uint64, len(inside))).tolist()
                    candidates = {n for band, value in enumerate(mark) for n in own["bands"].get((band, value), ())}
                    for n in sorted(candidates):
                        name, wanted, shingles = own["sets"][n]
                        if len(wanted & inside) < self.similarity * len(wanted):
                            continue
                        at = [i for i in range(w, stop) if hashes[i] in wanted and b" ".join(words[i : i + SHINGLE]) in shingles]
                        share = len({b" ".join(words[i : i + SHINGLE]) for i in at}) / len(shingles)
                        if share >= self.similarity:
                            found.append((name, at[0], at[-1] + SHINGLE, share))
        best: list[tuple[str, int, int, float]] = []
        for m in sorted(found, key=lambda m: (m[0], -m[3], m[1], m[2])):
            if not any(m[0] == o[0] and m[1] < o[2] and o[1] < m[2] for o in best):
                best.append(m)
        return sorted(best, key=lambda m: (m[1], m[0]))


MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]], *, text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` without ``text`` and with ``matches``; a column named so is replaced."""
    if sum(len(words_of(t)) for _, t in templates) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    source, back = kept_and(docs, text, ("matches",))
    kept = source.columns[:-1]
    sent = docs.sparkSession.sparkContext.broadcast(templates)
    at = len(kept)

    def run(batches):
        import pyarrow as pa

        index = TemplateIndex(sent.value, similarity)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))
        for batch in portions(batches, at):
            found = [[dict(zip(("license", "start", "end", "containment"), m)) for m in index.scan(words_of(t.as_py()))] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*kept, "matches"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("matches", T.ArrayType(MATCH))])).select(*back, "matches")
