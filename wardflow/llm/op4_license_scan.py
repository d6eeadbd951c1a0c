"""License notices inside documents, by MinHash bands over overlapping windows and exact containment.

A template is a set of word shingles (``K`` words; all its words where it has fewer). A template with
``m`` shingles is looked for in windows of ``2 * L`` shingles that begin at every multiple of ``L``,
where ``L`` is the smallest power of two that is at least ``m``: wherever it stands, whole, a window
holds it. Such a window's similarity to the template is at least 0.8 m / (2 L + 0.2 m) > 0.19, as a
match needs four fifths of the template. Signatures have ``HASHES`` minima, each a band of its own, so
a matching window shares a band with its template with probability 1 - 0.81^48 > 0.9999 or more; minima
of a window are those of its two halves, so all window sizes come from one pass. Templates of fewer than
``K`` words are one shingle, half of a window: ``SHORT_HASHES`` minima find them with 1 - 0.5^20 > 0.999999.
Windows that share a band are then compared with the template shingle by shingle: a match holds at least
``LEAST`` of them, all of them where there are fewer than ``2 * K``, and one around every word of the
template that has a digit, so that another version is no match. A match that lies in another template's
match of higher containment is left out. Nothing that is not there is reported.

Templates are a parameter; they are sent to every task, so their number must be bounded. Defined
results: NULL and empty texts match nothing; whole texts are read, long ones piece by piece; repeated
rows each give their matches; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 5
LEAST = 0.8
HASHES = 48
SHORT_HASHES = 20
_PIECE = 1 << 14
_WORD = re.compile(r"\w+")

# Words of common public licenses, the notices and the short forms that refer to them.
TEMPLATES = {
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at"
        " your option) any later version."
    ),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met"
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission."
    ),
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
        " 2.0 which is available at"
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
        " option) any later version."
    ),
    "gpl-2.0-short": "licensed under the GNU General Public License, version 2.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "gpl-3.0-short": "licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at"
        " your option) any later version."
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at"
        " your option) any later version."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so"
    ),
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"
    ),
    "spdx-agpl-3.0": "SPDX-License-Identifier: AGPL-3.0",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-2-clause": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl-2.0": "SPDX-License-Identifier: GPL-2.0",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-lgpl-2.1": "SPDX-License-Identifier: LGPL-2.1",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software."
    ),
}


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_hashes(text: str) -> np.ndarray:
    import xxhash

    words = [word.encode() for word in split_words(text)]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` words in a row, by their place."""
    out = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def minima(hashes: np.ndarray, size: int, n: int = HASHES) -> np.ndarray:
    """(n, blocks): for each of ``n`` hash functions the least value in each block of ``size`` shingles."""
    draw = np.random.default_rng(5)
    odd = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    blocks = -(-len(hashes) // size)
    padded = np.full((n, blocks * size), np.uint64((1 << 64) - 1))
    mixed = hashes ^ (hashes >> np.uint64(29))
    padded[:, : len(hashes)] = mixed * odd[:, None]
    padded[:, : len(hashes)] ^= padded[:, : len(hashes)] >> np.uint64(32)
    return padded.reshape(n, blocks, size).min(axis=2) if size > 1 else padded


@dataclass(frozen=True)
class Template:
    name: str
    k: int
    shingles: np.ndarray  # sorted, distinct
    half: int  # L
    least: float  # the share of its shingles that a match holds
    versions: list[np.ndarray]  # for each word with a digit: the shingles around it
    signature: np.ndarray  # (HASHES,), or (SHORT_HASHES,)


def _n_hashes(k: int) -> int:
    return HASHES if k == K else SHORT_HASHES


def prepare(templates: Mapping[str, str]) -> list[Template]:
    out = []
    for name, text in sorted(templates.items()):
        words = word_hashes(text)
        if not len(words):
            continue
        k = min(K, len(words))
        in_order = shingles(words, k)
        own = np.unique(in_order)
        half = 1 << (len(in_order) - 1).bit_length()
        numbers = [i for i, word in enumerate(split_words(text)) if any(map(str.isdigit, word))]
        versions = [in_order[max(0, i - k + 1) : i + 1] for i in numbers]
        least = LEAST if len(own) >= 2 * K else 1.0
        out.append(Template(name, k, own, half, least, versions, minima(own, len(own), _n_hashes(k))[:, 0]))
    return out


def _halved(least: np.ndarray) -> np.ndarray:
    """Minima of blocks twice as large."""
    if least.shape[1] % 2:
        least = np.concatenate([least, np.full((len(least), 1), np.uint64((1 << 64) - 1))], axis=1)
    return np.minimum(least[:, ::2], least[:, 1::2])


def find(text: str, templates: list[Template]) -> list[tuple[str, int, int, float]]:
    """(template, first word, last word, containment) of every stretch of the text that matches."""
    words = word_hashes(text)
    found: dict[str, list[tuple[int, int, float]]] = {}
    for k in sorted({t.k for t in templates}):
        own = [t for t in templates if t.k == k]
        places = shingles(words, k)
        largest = max(t.half for t in own)
        piece = max(_PIECE, 2 * largest)
        for first in range(0, len(places), piece):
            # A piece also reads the largest block after it, so windows across its end are whole.
            part = places[first : first + piece + largest]
            least, half = minima(part, 1, _n_hashes(k)), 1
            while True:
                windows = least.copy()
                windows[:, :-1] = np.minimum(least[:, :-1], least[:, 1:])
                for template in own:
                    if template.half == half:
                        at = np.flatnonzero((windows == template.signature[:, None]).any(axis=0))
                        _verify(template, part, at, first, found)
                if half == largest:
                    break
                least, half = _halved(least), 2 * half
    out = []
    for name, stretches in found.items():
        out.extend((name, *stretch) for stretch in _merged(stretches))
    return sorted(_not_outdone(out))


def _verify(template: Template, part: np.ndarray, windows: np.ndarray, first: int, found: dict) -> None:
    for window in windows:
        begin = window * template.half
        inside = part[begin : begin + 2 * template.half]
        at = np.searchsorted(template.shingles, inside)
        hit = template.shingles[np.minimum(at, len(template.shingles) - 1)] == inside
        share = len(np.unique(inside[hit])) / len(template.shingles)
        if share >= template.least and all(np.isin(around, inside).any() for around in template.versions):
            where = np.flatnonzero(hit)
            stretch = (int(first + begin + where[0]), int(first + begin + where[-1] + template.k - 1), share)
            found.setdefault(template.name, []).append(stretch)


def _merged(stretches: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Overlapping stretches as one, with the highest containment among them."""
    out: list[tuple[int, int, float]] = []
    for begin, end, share in sorted(stretches):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), max(share, out[-1][2]))
        else:
            out.append((begin, end, share))
    return out


def _not_outdone(matches: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The matches that do not lie in a better one: where wordings are alike, the better one names the license."""
    out, around = [], []
    for match in sorted(matches, key=lambda m: (m[1], -m[2], -m[3])):
        # Stretches of one template never overlap, so there are at most as many as templates.
        around = [other for other in around if other[2] >= match[1]]
        if not any(other[2] >= match[2] and other[3] > match[3] for other in around):
            out.append(match)
        around.append(match)
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per match: doc_id, license, first_word, last_word (from 0) and containment."""
    prepared = docs.sparkSession.sparkContext.broadcast(prepare(templates))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    names = ["doc_id", "license", "first_word", "last_word", "containment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows.extend((doc_id, *match) for match in find(text or "", prepared.value))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, first_word long, last_word long, containment double")
