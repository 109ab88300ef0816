"""License scans: finds passages of known license notices in texts.

Texts and templates are sequences of words (letters and digits, A-Z lower-cased) and of
their five-word shingles. Windows of shingles, overlapping by half in a text and starting at every
shingle in a template, get MinHash signatures; windows that share all rows of one band
name a template. With s the Jaccard index of two windows, r rows a band and
b bands, the pair is missed with probability (1 - s**r)**b; b is chosen so that this
stays under a bound at the threshold. A passage in which words were replaced has windows no worse than its mean, so it is
missed with that probability at most; where words were put in or left out windows shift against each other and
no such bound holds (the tests measure the recall). Each retrieved template is then verified exactly: the share of its
shingles within a passage of its own length must reach the threshold.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_texts import TEXTS

# Notices of public licenses, name and text.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

SHINGLE = 5
#: Sizes of windows in shingles; a template uses the largest that fits.
WINDOWS = (1, 4, 16)
#: Bytes to word characters: A-Z lower-cased, other ASCII but letters and digits to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def bands(similarity: float, rows: int, miss: float) -> int:
    """Fewest bands that miss a window of this similarity with a probability of at most ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity**rows))) if similarity < 1 else 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(found: list[bytes]) -> np.ndarray:
    """One hash for each run of five words, by place of its first word."""
    from xxhash import xxh64_intdigest

    n = len(found) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = _mixed(out * _M + h[k : k + n])
    return out


def signatures(shingles: np.ndarray, window: int, step: int, n_hashes: int) -> np.ndarray:
    """MinHash of every ``step``-th window; the last window ends with the last shingle. One row per hash function."""
    n = len(shingles) - window + 1
    if n <= 0:
        return np.zeros((n_hashes, 0), np.uint64)
    at = np.unique(np.append(np.arange(0, n, step), n - 1))
    out = np.empty((n_hashes, len(at)), np.uint64)
    for k in range(n_hashes):
        least, width = _mixed(shingles ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)), 1
        while width < window:  # windows are powers of two: double the width
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        out[k] = least[at]
    return out


def band_keys(signature: np.ndarray, rows: int, window: int) -> np.ndarray:
    """A key for each band and window: hash of the band's rows, its number and the window size."""
    n_bands = signature.shape[0] // rows
    keys = np.empty((n_bands, signature.shape[1]), np.uint64)
    for b in range(n_bands):
        key = np.full(signature.shape[1], b * 1000 + window, np.uint64)
        for r in range(rows):
            key = _mixed(key * _M + signature[b * rows + r])
        keys[b] = key
    return keys


class Scanner:
    """Templates with the index of their bands; finds their passages in a list of words."""

    def __init__(self, templates=TEMPLATES + TEXTS, threshold: float = 0.8, rows: int = 2, miss: float = 1e-3):
        self.threshold, self.rows, self.names = threshold, rows, [name for name, _ in templates]
        # a share t of equal shingles among two windows of one size is a Jaccard of t / (2 - t)
        self.n_bands = bands(threshold / (2 - threshold), rows, miss)
        self.words = [words(text.encode()) for _, text in templates]
        self.shingles = [{tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for w in self.words]
        if not all(self.shingles):
            raise ValueError("a template needs at least five words")
        entries: dict[int, dict[int, set[int]]] = {}
        for t, w in enumerate(self.words):
            h = shingle_hashes(w)
            window = max(x for x in WINDOWS if x <= len(h))
            for row in self._keys(h, window, 1):
                for key in row.tolist():
                    entries.setdefault(window, {}).setdefault(key, set()).add(t)
        self.index = {}
        for window, got in entries.items():
            keys = np.array(sorted(got), np.uint64)
            known = np.zeros(1 << 20, bool)  # by a key's first 20 bits: few keys of a text are searched for
            known[keys >> np.uint64(44)] = True
            self.index[window] = (keys, [sorted(got[k]) for k in keys.tolist()], known)

    def _keys(self, h: np.ndarray, window: int, step: int) -> np.ndarray:
        if window == 1:  # one shingle is its own signature: a single band finds it surely
            return band_keys(h[None, :], 1, 1)
        return band_keys(signatures(h, window, step, self.n_bands * self.rows), self.rows, window)

    def candidates(self, found: list[bytes]) -> dict[int, list[int]]:
        """Template -> places (of shingles) of windows that share a band with it."""
        h = shingle_hashes(found)
        out: dict[int, list[int]] = {}
        for window, (keys, templates, known) in self.index.items():
            step = max(1, window // 2)
            n = len(h) - window + 1
            if n <= 0:
                continue
            at = np.unique(np.append(np.arange(0, n, step), n - 1)) if window > 1 else np.arange(n)
            for row in self._keys(h, window, step):
                likely = np.flatnonzero(known[row >> np.uint64(44)])
                spot = np.minimum(np.searchsorted(keys, row[likely]), len(keys) - 1)
                for i in np.flatnonzero(keys[spot] == row[likely]).tolist():
                    for t in templates[int(spot[i])]:
                        out.setdefault(t, []).append(int(at[likely[i]]))
        return out

    def passages(self, t: int, found: list[bytes], low: int, high: int) -> list[tuple[int, int, int]]:
        """(distinct shingles of template t, first shingle, last shingle) of passages that begin in low .. high, reach the threshold and do not overlap."""
        wanted, reach = self.shingles[t], len(self.words[t])
        shingle = {i: tuple(found[i : i + SHINGLE]) for i in range(low, min(len(found) - SHINGLE + 1, high + reach))}
        hits = [i for i, x in shingle.items() if x in wanted]
        inside: Counter = Counter()
        ahead, best, out = 0, None, []
        for k, start in enumerate(hits):
            if best is not None and start > best[2]:
                out.append(best)
                best = None
            while ahead < len(hits) and hits[ahead] < start + reach:
                inside[shingle[hits[ahead]]] += 1
                ahead += 1
            n = len(inside)
            if n >= self.threshold * len(wanted) and (best is None or n > best[0]) and (not out or start > out[-1][2]):
                best = (n, start, hits[ahead - 1])
            inside[shingle[start]] -= 1
            if not inside[shingle[start]]:
                del inside[shingle[start]]
        return out if best is None else [*out, best]

    def matches(self, raw: bytes) -> list[tuple[str, int, int, float]]:
        """(license, first word, word after the last, containment) of every verified passage, in order."""
        found = words(raw)
        out = set()
        for t, places in self.candidates(found).items():
            reach = len(self.words[t])
            places = np.unique(places)
            for near in np.split(places, np.flatnonzero(np.diff(places) > reach) + 1):
                for n, first, last in self.passages(t, found, max(0, int(near[0]) - reach), int(near[-1])):
                    out.add((self.names[t], first, last + SHINGLE, round(n / len(self.shingles[t]), 6)))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(df: DataFrame, templates=TEMPLATES + TEXTS, threshold: float = 0.8, text: str = "text", **how) -> DataFrame:
    """doc_id, licenses (sorted names), matches (license, start, stop, containment) of every row.

    start and stop count words. A license whose text holds another's (the longer BSD text, say) may name both. Null, empty and clean texts have empty arrays; repeated rows are
    scanned each. The templates are a fixed list, so what goes to the workers is bounded by it.
    """

    def run(batches):
        scanner = Scanner(templates, threshold, **how)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            got = [scanner.matches(x.as_py()) for x in batch.column("text")]
            rows = [[dict(zip(("license", "start", "stop", "containment"), m, strict=True)) for m in ms] for ms in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sorted({m[0] for m in ms}) for ms in got], pa.list_(pa.string())), pa.array(rows, kind)],
                names=["doc_id", "licenses", "matches"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", text_or_empty(text).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, licenses array<string>, matches array<struct<license: string, start: bigint, stop: bigint, containment: double>>"
    )
