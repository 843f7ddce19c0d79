"""Operator 10, license scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Notices of common licenses, by SPDX name; each of five words at least. Several notices may share a name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
)

#: Words in a shingle, and the share of a template's shingles that a match has at least.
WORDS, CONTAINED = 5, 0.8
#: The chance that no band of a window that holds a match finds its template is at most this.
MISSED = 1e-4
#: Words of a chunk of texts that are hashed together.
CHUNK = 100_000

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased; other ASCII characters separate them."""
    return text.encode().translate(_PLAIN).split()


def shingles(found: list[bytes]) -> np.ndarray:
    """A hash of each run of WORDS words."""
    n = len(found) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out = h[:n].copy()
    for k in range(1, WORDS):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
    return out


def _shuffled(h: np.ndarray, band: int) -> np.ndarray:
    """The band's own order of shingles: a mixing of 64 bits with the band's constants."""
    a = np.uint64(xxhash.xxh64_intdigest(band.to_bytes(4, "little"), 1))
    b = np.uint64(xxhash.xxh64_intdigest(band.to_bytes(4, "little"), 2) | 1)
    x = (h ^ a) * b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Templates:
    """Templates by scale, the power of two from their number of shingles, with the minima of their bands.

    Windows of a scale are runs of blocks of a quarter of it, one block apart, one block longer than the scale, so some
    window holds all of a match. A match shares enough with it that the Jaccard similarity is at least `least`; with one
    hash a band, `bands` bands miss it with a chance of (1 - least) ** bands, which sets their number."""

    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.names, self.texts = [n for n, _ in templates], [words(t) for _, t in templates]
        self.hashes = [np.unique(shingles(t)) for t in self.texts]
        if any(not len(h) for h in self.hashes):
            raise ValueError(f"a template needs {WORDS} words")
        self.exact = [{b" ".join(t[i : i + WORDS]) for i in range(len(t) - WORDS + 1)} for t in self.texts]
        self.known = np.unique(np.concatenate(self.hashes))
        self.longest = [len(t) - WORDS + 1 for t in self.texts]
        self.scales = {}
        for t, n in enumerate(self.longest):
            self.scales.setdefault(1 << (n - 1).bit_length(), []).append(t)
        self.plans = []
        for scale, members in sorted(self.scales.items()):
            block = max(1, scale // 4)
            run = scale // block + (block > 1)
            least = min(ceil(CONTAINED * len(self.hashes[t])) / (run * block + len(self.hashes[t]) - ceil(CONTAINED * len(self.hashes[t]))) for t in members)
            bands = 1 if least >= 1 else ceil(log(MISSED) / log(1 - least))
            minima = [{int(_shuffled(self.hashes[t], k).min()): t for t in members} for k in range(bands)]
            shared = [{v: [t for t in members if int(_shuffled(self.hashes[t], k).min()) == v] for v in minima[k]} for k in range(bands)]
            self.plans.append((scale, block, run, bands, shared))
        self.most = max(p[3] for p in self.plans)

    def candidates(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, after) of windows one of whose bands has a template's minimum."""
        found = set()
        for band in range(self.most):
            x, mins, size = _shuffled(h, band), None, 0
            for scale, block, run, bands, shared in self.plans:
                if band >= bands:
                    continue
                if size != block:
                    if mins is None or block % size:
                        mins = x
                        size = 1
                    if block > size:
                        mins = np.minimum.reduceat(mins, np.arange(0, len(mins), block // size))
                        size = block
                low = mins
                width = 1
                while width < run:
                    step = min(width, run - width)
                    if len(low) <= step:
                        break
                    low = np.minimum(low[:-step], low[step:])
                    width += step
                want = np.array(sorted(shared[band]), np.uint64)
                at = np.searchsorted(want, low)
                hit = np.flatnonzero(want[np.minimum(at, len(want) - 1)] == low)
                for w in hit:
                    for t in shared[band][int(low[w])]:
                        found.add((t, max(0, int(w) * block), min(len(h), (int(w) + run) * block)))
        return found


    def spread(self, h: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, template, shingles' places) where a whole text, however long, holds enough of a template's shingles."""
        hit = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h)
        text = np.searchsorted(ends, hit, side="right")
        inside = hit + WORDS <= ends[np.minimum(text, len(ends) - 1)]
        hit, text = hit[inside], text[inside]
        cuts = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = h[hit[lo:hi]]
            some = np.unique(own)
            for t, hashes in enumerate(self.hashes):
                if len(some) >= CONTAINED * len(hashes) and np.isin(hashes, some).mean() >= CONTAINED:
                    yield int(text[lo]), t, hit[lo:hi][np.isin(own, hashes)]


#: Templates that a table may hold: they travel with each task.
MOST_TEMPLATES = 10_000


def templates_from(table: DataFrame) -> tuple[tuple[str, str], ...]:
    """Templates from a table (license, text): whole license texts or notices. Rows with nulls or of fewer than WORDS
    words are left out, repeated ones count once; more than MOST_TEMPLATES are refused."""
    rows = table.where("license is not null and text is not null").select("license", "text").distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return tuple(sorted((r[0], r[1]) for r in rows if len(words(r[1])) >= WORDS))


def shortest(places: list[int], held: list[bytes]) -> tuple[int, int]:
    """The first and last place of the shortest run of places that holds every shingle held, the first of equals."""
    need, counts, lo, best = len(set(held)), {}, 0, (places[0], places[-1])
    for hi, x in enumerate(held):
        counts[x] = counts.get(x, 0) + 1
        while counts[held[lo]] > 1:
            counts[held[lo]] -= 1
            lo += 1
        if len(counts) == need and places[hi] - places[lo] < best[1] - best[0]:
            best = places[lo], places[hi]
    return best


def matches(texts: list[str], templates: Templates) -> list[list[tuple[str, float, int, int]]]:
    """For each whole text its licenses: (name, containment, first word, word after) of the best place of each.

    A place is a window; if none holds enough, as when a passage was inserted, it is the shortest run of words with all
    of the template's shingles that the whole text has."""
    out: list[dict] = [{} for _ in texts]
    at, found = 0, [words(t) for t in texts]
    while at < len(found):
        to, size = at, 0
        while to < len(found) and (to == at or size + len(found[to]) <= CHUNK):
            size += len(found[to])
            to += 1
        flat = [w for f in found[at:to] for w in f]
        ends = np.cumsum([len(f) for f in found[at:to]])
        h = shingles(flat)
        for t, first, after in templates.candidates(h) if len(h) else ():
            for d in range(int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(ends, after + WORDS - 1)) + 1):
                if d >= len(ends):
                    break
                begin = int(ends[d - 1]) if d else 0
                lo, hi = max(first, begin), min(after, int(ends[d]) - WORDS + 1)
                places = [i for i in range(lo, hi) if b" ".join(flat[i : i + WORDS]) in templates.exact[t]]
                share = len({b" ".join(flat[i : i + WORDS]) for i in places}) / len(templates.exact[t])
                if share >= CONTAINED:
                    one = (share, begin - places[0], places[0] - begin, places[-1] + WORDS - begin)
                    name = templates.names[t]
                    out[at + d][name] = max(out[at + d].get(name, one), one)
        for d, t, hit in templates.spread(h, ends) if len(h) else ():
            name, places = templates.names[t], [i for i in hit.tolist() if b" ".join(flat[i : i + WORDS]) in templates.exact[t]]
            held = [b" ".join(flat[i : i + WORDS]) for i in places]
            share = len(set(held)) / len(templates.exact[t])
            if share >= CONTAINED and name not in out[at + d]:
                begin = int(ends[d - 1]) if d else 0
                first, last = shortest(places, held)
                out[at + d][name] = (share, begin - first, first - begin, last + WORDS - begin)
        at = to
    return [[(name, v[0], v[2], v[3]) for name, v in sorted(o.items())] for o in out]


def license_report(docs: DataFrame, templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES) -> DataFrame:
    """A row for each license found in a row of docs (doc_id, text): doc_id, license, containment, first_word and
    after_word (words as words() has them, of the best place, the first of equals).

    One pass over whole texts without a shuffle; templates are a parameter, a table (license, text) too, and are sent to
    each worker once. Null, empty and
    shorter texts have none; repeated rows report each; an empty table gives no rows; other columns are ignored."""

    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates_from(templates) if isinstance(templates, DataFrame) else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, *m) for i, ms in zip(ids, matches([t.as_py() or "" for t in batch.column("text")], known), strict=True) for m in ms]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "containment", "first_word", "after_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, containment double, first_word long, after_word long")
