"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment confirms.

Templates of similar length form a class. A class looks at windows of twice its longest
template that overlap by half, so any run as long as a template lies inside one window. A
window that contains ``CONTAINED`` of a template's shingles has a Jaccard similarity with it
of at least ``least_similarity``; bands of one hash collide with probability 1 - (1 - J) ** bands,
and the number of bands is set so that a match is missed with probability ``MISSED`` at most.
What the bands retrieve is verified by the exact share of the template's shingles in the window.

Shingles have five words (a shorter template is one shingle). Texts are scanned whole, where
they lie; nothing is shuffled. Templates are a parameter of a few hundred texts, not data:
``known()`` reads the table beside the code, license-form -> text. A license's forms (its notice,
``-line``, ``-use-line``, ``-spdx``, ``-text``) are no rivals of each other.

Defined cases: null, empty and word-free texts match nothing; a text shorter than a window
is one window; of overlapping windows that match a template the first of the best is reported; a
window may hold a template several times; of overlapping matches of different licenses the one with
more shingles found is reported (a notice of version 2 is most of one of version 3); columns
named like the results are renamed ``*_in`` first.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from pathlib import Path
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import text as tx

SHINGLE = 5
CONTAINED = 80          # percent
MISSED = 1e-5
# fixed values: notices of public licenses
TEMPLATES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
TABLE = Path(__file__).with_name("license_templates.json")
RESULT = {"n_words": "long", "licenses": "array<struct<license:string,start:int,end:int,percent:int>>"}
_SEEDS = np.random.default_rng(7).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def known() -> dict[str, str]:
    """The usual notices, one-line forms, SPDX tags and texts of public licenses, by name."""
    return json.loads(TABLE.read_text(encoding="utf-8"))


def family(name: str) -> str:
    """The license that a template is a form of."""
    return re.sub(r"(-only|-or-later)?(-use-line|-line|-spdx|-text)?$", "", name)


def template_words(text: str) -> tuple[np.ndarray, int]:
    hashes, counts = tx.word_hashes([text.encode()], lower=True, table=tx.LETTERS)
    return hashes, int(counts[0])


class TemplateClass:
    """Templates of one shingle length and similar size."""

    def __init__(self, size: int, templates: dict[str, tuple[np.ndarray, int]], missed: float):
        longest, least = max(n for _, n in templates.values()), min(n for _, n in templates.values())
        self.size, self.stride = size, longest
        self.sets = {name: np.unique(tx.windows(words, size)) for name, (words, _) in templates.items()}
        self.times = {name: Counter(tx.windows(words, size).tolist()) for name, (words, _) in templates.items()}
        share = CONTAINED / 100
        smallest = min(map(len, self.sets.values()))
        others = 2 * longest - size + 1
        self.least_similarity = share * smallest / (others + (1 - share) * smallest)
        self.bands = ceil(log(missed) / log(1 - self.least_similarity))
        self.seeds = _SEEDS[: self.bands]
        self.index: list[dict[int, list[str]]] = [defaultdict(list) for _ in range(self.bands)]
        for name, own in self.sets.items():
            for band, low in enumerate(self.minima(own[None, :])[0].tolist()):
                self.index[band][low].append(name)
        self.known = [np.array(sorted(x), np.uint64) for x in self.index]

    def minima(self, rows: np.ndarray) -> np.ndarray:
        """Smallest value of each row under every band's permutation (odd multiples modulo 2**64)."""
        return np.stack([(rows * s).min(axis=1) for s in self.seeds], axis=1)

    def occurrences(self, name: str, keys: list[int], hit: list[int]) -> list[tuple[int, int, int]]:
        """(first, last, distinct) of disjoint runs of hits that hold enough of a template, no shingle more often than it does."""
        times, need = self.times[name], CONTAINED * len(self.sets[name])
        seen, left, found = Counter(), 0, []
        for i, key in enumerate(keys):
            if seen[key] == times[key]:
                if 100 * len(seen) >= need:
                    found.append((-len(seen), hit[left], hit[i - 1]))
                while seen[key] == times[key]:
                    seen[keys[left]] -= 1
                    if not seen[keys[left]]:
                        del seen[keys[left]]
                    left += 1
            seen[key] += 1
        if 100 * len(seen) >= need:
            found.append((-len(seen), hit[left], hit[-1]))
        out: list[tuple[int, int, int]] = []
        for both, first, last in sorted(found):
            if all(last < a or first > b for a, b, _ in out):
                out.append((first, last, -both))
        return sorted(out)

    def scan(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, str, int, int, int, int]]:
        """(text, license, first word, end, percent, shingles) of the templates that windows contain, over texts end to end."""
        at, owner = tx.inner_windows(counts, self.size)
        shingles = tx.windows(hashes, self.size)[at]
        if not len(shingles):
            return []
        each = np.bincount(owner, minlength=len(counts))
        place = np.concatenate([[0], np.cumsum(each)])
        wide = 2 * self.stride - self.size + 1
        number = np.where(each > 0, -(-np.maximum(1, each - self.stride + self.size - 1) // self.stride), 0)
        text = np.repeat(np.arange(len(counts)), number)
        nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        a = place[text] + nth * self.stride
        b = np.minimum(a + wide, place[text + 1])
        edges = np.unique(np.concatenate([a, b]))[:-1]  # windows are runs of the pieces between edges
        pieces = np.stack([np.searchsorted(edges, a), np.searchsorted(edges, b)], axis=1)
        wanted = set()
        for band, seed in enumerate(self.seeds):
            low = np.minimum.reduceat(shingles * seed, edges)
            for piece in np.flatnonzero(np.isin(low, self.known[band])).tolist():
                last = int(np.searchsorted(a, edges[piece], side="right")) - 1
                for w in (last, last - 1):  # the windows that hold the piece, if it is their minimum
                    if w >= 0 and edges[piece] < b[w] and low[pieces[w, 0]:pieces[w, 1]].min() == low[piece]:
                        wanted.update((w, name) for name in self.index[band][int(low[piece])])
        out = []
        for w, name in sorted(wanted):
            own, inside = self.sets[name], shingles[a[w]:b[w]]
            hit = np.flatnonzero(np.isin(inside, own))
            both = len(np.unique(inside[hit]))
            if 100 * both >= CONTAINED * len(own):
                start = int(a[w] - place[text[w]])
                for first, last, n in self.occurrences(name, inside[hit].tolist(), hit.tolist()):
                    out.append((int(text[w]), name, start + first, start + last + self.size, 100 * n // len(own), n))
        return out


def classes(templates: dict[str, str], missed: float = MISSED) -> list[TemplateClass]:
    groups: dict[tuple[int, int], dict] = defaultdict(dict)
    for name, text in templates.items():
        words, n = template_words(text)
        if n:
            groups[(min(SHINGLE, n), n.bit_length())][name] = (words, n)
    return [TemplateClass(size, group, missed) for (size, _), group in sorted(groups.items())]


def best(found: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Of overlapping matches of one template the first of the most complete; of other licenses' matches in the same
    place (half of the shorter one or more) the one with the most shingles."""
    out: list[tuple[str, int, int, int, int]] = []
    for match in sorted(found):
        if out and out[-1][0] == match[0] and match[1] < out[-1][2]:
            if match[3] > out[-1][3]:
                out[-1] = match
        else:
            out.append(match)
    kept: list[tuple[str, int, int, int, int]] = []
    for m in sorted(out, key=lambda m: (-m[4], m[1], m[0])):
        if not any(family(k[0]) != family(m[0]) and 2 * (min(k[2], m[2]) - max(k[1], m[1])) >= min(k[2] - k[1], m[2] - m[1]) for k in kept if not k[0].endswith("-text")):
            kept.append(m)
    return sorted([m[:4] for m in kept], key=lambda m: (m[1], m[0]))


def licensed(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` with n_words and licenses: the templates found, where (in words) and how complete."""
    docs = tx.renamed(docs, RESULT)
    more = T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in RESULT.items()))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("percent", pa.int32())]))

    def run(batches):
        tx.release_memory()
        own = classes(templates)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                texts = [b"" if t is None else t for t in batch.column(text).cast(pa.binary()).to_pylist()]
                hashes, counts = tx.word_hashes(texts, lower=True, table=tx.LETTERS)
                found = defaultdict(list)
                for d, *match in (m for c in own for m in c.scan(hashes, counts)):
                    found[d].append(tuple(match))
                rows = [[{"license": n, "start": a, "end": b, "percent": p} for n, a, b, p in best(found.get(d, []))] for d in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(rows, kind)], names=[*batch.schema.names, *RESULT])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + more.fields))
