"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

A template is the set of its word shingles. Windows of a document are as long as a template's
size class and start at every quarter of that length; sliding minima give the MinHash of each
window, and a window whose minimum equals a template's in one of BANDS bands retrieves it. With
one row a band, a window that holds 0.8 of a template of its class has a Jaccard similarity of
0.5 or more, so it is retrieved with a probability of 1 - 0.5 ** BANDS or more. Retrieved
templates are then verified by exact containment of their shingles around the window.

Defined cases: null and empty texts match nothing; a text or template of fewer words than a
shingle is one shingle; a template without words is left out; very long texts are read whole, by
themselves, and a passage counts wherever it stands in one; repeated rows are reported each;
of equally good places of a template in a text the first is reported; an empty table or no
templates give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tidemill.llm.common import map_rows, table

SHINGLE, CONTAINED, BANDS = 5, 0.8, 20
#: Words whose windows are looked at together.
TOGETHER = 100_000
CACHE_ROWS = 300_000

#: Short notices and the opening passages of common licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}

_NOTICE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
#: Standard notices of the licenses near GPL-3.0.
FAMILY = {
    "GPL-2.0": _NOTICE.format("program", ";", "", ";", "2"),
    "LGPL-2.0": _NOTICE.format("library", ";", "Library ", ";", "2"),
    "LGPL-2.1": _NOTICE.format("library", ";", "Lesser ", ";", "2.1"),
    "LGPL-3.0": _NOTICE.format("library", ":", "Lesser ", ",", "3"),
    "AGPL-3.0": _NOTICE.format("program", ":", "Affero ", ",", "3"),
}
#: Words of a section of a license's whole text; the next one starts at half of it.
SECTION = 64

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def sections(name: str, text: str) -> dict[str, str]:
    """A whole text as overlapping templates name#0, name#1, ...; the last one ends where the text does."""
    own = [w.decode("utf-8", "surrogatepass") for w in words(text)]
    starts = [*range(0, max(1, len(own) - SECTION), SECTION // 2), max(0, len(own) - SECTION)]
    return {f"{name}#{n}": " ".join(own[a : a + SECTION]) for n, a in enumerate(sorted(set(starts)))}


def registered() -> dict[str, str]:
    """The templates, the notices near GPL-3.0, and the sections of whole license texts."""
    out = TEMPLATES | {f"{name}#notice": text for name, text in FAMILY.items()}
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out |= sections(file.stem, file.read_text("utf-8"))
    return out


def settled(found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """One match a license, its best one; where two of about one place and length differ, the better stays."""
    def same_place(x: tuple, y: tuple) -> bool:
        return 2 * (min(x[3], y[3]) - max(x[2], y[2])) > max(x[3] - x[2], y[3] - y[2])

    best: dict[str, tuple[str, float, int, int]] = {}
    for m in found:
        name = m[0].partition("#")[0]
        if not any(o[1] > m[1] and o[0].partition("#")[0] != name and same_place(m, o) for o in found):
            if name not in best or (m[1], -m[2]) > (best[name][1], -best[name][2]):
                best[name] = (name, *m[1:])
    return sorted(best.values())


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of each run of SHINGLE words; of all words if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, SHINGLE)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : n - width + 1 + k]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def size_class(n: int) -> int:
    """The least of 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, ... that isn't below n."""
    c = 1
    while c < n:
        c += max(1, 1 << max(0, c.bit_length() - 2))
    return c


def permuted(x: np.ndarray, bands: int) -> Iterator[np.ndarray]:
    """Hash values under each band's permutation."""
    r = np.random.default_rng(23)
    for a, b in r.integers(1, 1 << 63, (bands, 2), dtype=np.uint64):
        yield (x ^ b) * (a | np.uint64(1))


class Index:
    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        self.bands, self.names, self.sets = bands, [], []
        self.cache: dict[bytes, int] = {}
        for name, text in sorted(templates.items()):
            if len(s := np.unique(shingles(self.hashed(words(text))))):
                self.names.append(name)
                self.sets.append(s)
        self.classes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            self.classes.setdefault(size_class(len(s)), []).append(t)
        self.minima = [[int(p.min()) for p in permuted(s, bands)] for s in self.sets]
        self.having: dict[tuple[int, int, int], list[int]] = {}
        for t, s in enumerate(self.sets):
            for band, m in enumerate(self.minima[t]):
                self.having.setdefault((size_class(len(s)), band, m), []).append(t)
        # For each class and band: a bit table of the minima's top bits, so that most windows stop there.
        self.bits = {}
        for c, own in self.classes.items():
            self.bits[c] = np.zeros((bands, 1 << 16), bool)
            for t in own:
                self.bits[c][np.arange(bands), [m >> 48 for m in self.minima[t]]] = True

    def hashed(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.cache) >= CACHE_ROWS:
            self.cache = {}
        cache = self.cache
        for w in set(tokens).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))

    def find_many(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text: (template, containment, start word, end word), sorted by template."""
        split = [words(t) for t in texts]
        own = [shingles(self.hashed(w)) for w in split]
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        if not self.sets or not any(map(len, own)):
            return [[] for _ in texts]
        x = np.concatenate(own)
        start = np.cumsum([0, *map(len, own)])
        doc = np.repeat(np.arange(len(own)), np.diff(start))
        seen: set[tuple[int, int, int]] = set()
        for band, p in enumerate(permuted(x, self.bands)):
            doubled = {1: p}
            for c in sorted(self.classes):
                # The minimum over c shingles is that of two runs of a power of two that overlap.
                w = 1 << (c.bit_length() - 1)
                if c > len(p):
                    low, step = p, 1
                else:
                    k = max(doubled)
                    while k < w:
                        doubled[2 * k] = np.minimum(doubled[k][:-k], doubled[k][k:])
                        k *= 2
                    low = doubled[w] if w == c else np.minimum(doubled[w][: len(p) - c + 1], doubled[w][c - w :])
                    step = max(1, c // 4)
                low = low[::step]
                for at in np.flatnonzero(self.bits[c][band][(low >> np.uint64(48)).astype(np.int64)]).tolist():
                    for t in self.having.get((c, band, int(low[at])), ()):
                        seen.add((t, c, at * step))
            # Windows over the ends of texts see no single text; each end is looked at by itself.
            for c in self.classes:
                if c > 1:
                    self._ends(p, start, c, band, seen)
        for t, c, at in sorted(seen):
            for d in range(int(doc[at]), int(doc[min(at + c - 1, len(doc) - 1)]) + 1):
                a, b = max(int(start[d]), at - c), min(int(start[d + 1]), at + 2 * c)
                if a < b:
                    self._verify(x[a:b], a - int(start[d]), t, best[d])
        return [[(self.names[t], *v) for t, v in sorted(found.items())] for found in best]

    def _ends(self, p, start, c, band, seen) -> None:
        """The windows that hold the first and the last c shingles of each text, or all of a shorter one."""
        n = np.diff(start)
        some = np.flatnonzero(n > 0)
        for from_end in (False, True):
            a = np.where(from_end, np.maximum(start[some], start[some + 1] - c), start[some])
            b = np.minimum(a + c, start[some + 1])
            flat = np.column_stack([a, b]).ravel()
            low = np.minimum.reduceat(np.r_[p, p[-1:]], flat)[::2]
            for k in np.flatnonzero(self.bits[c][band][(low >> np.uint64(48)).astype(np.int64)]).tolist():
                for t in self.having.get((c, band, int(low[k])), ()):
                    seen.add((t, c, int(a[k])))

    def _verify(self, near: np.ndarray, offset: int, t: int, best: dict) -> None:
        """Exact containment of a template in the best run of as many shingles near a window."""
        own = self.sets[t]
        hit = np.isin(near, own)
        if not hit.any():
            return
        places = np.flatnonzero(hit)
        width = max(size_class(len(own)), int(len(own) / CONTAINED))
        for s in places.tolist():
            held = len(np.unique(near[s : s + width][hit[s : s + width]])) / len(own)
            e = int(places[places < s + width][-1]) + SHINGLE
            if held >= CONTAINED and (t not in best or (held, -(offset + s)) > (best[t][0], -best[t][1])):
                best[t] = (held, offset + s, offset + e)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found: containment, and its words' start and end.

    A template name#part is one of several of the license name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        index = Index(shared.value)
        keys, texts, size = [], [], 0

        def done() -> Iterator[tuple]:
            for i, found in zip(keys, index.find_many(texts), strict=True):
                for name, held, a, b in settled(found):
                    yield i, name, held, a, b

        for i, text in rows:
            keys.append(i)
            texts.append(text)
            size += len(text or "") // 6
            if size > TOGETHER:
                yield from done()
                keys, texts, size = [], [], 0
        yield from done()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"doc_id {kind}, license string, containment double, start_word long, end_word long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), registered())
