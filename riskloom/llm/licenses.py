"""License scans by conditional compression.

Lines with a cue word and those near them are read together, so a notice may be wrapped over lines or stand inside prose. The words of
such a stretch that stand in runs of three as in a template mark where it may hold a notice: a candidate block is the longest window in
which such words prevail, cut where the template would begin anew. A block is compressed alone and with each template as a
raw dictionary, and the templates that save most, as a share of the block's own size, are its candidates. As compression also
rewards wording that templates share, the winner is confirmed by exact wording: the words of the block that the
template does not have in the same order, found by aligning the two word by word.
"""

from __future__ import annotations

import bisect
import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: The public wording of common notices, by license.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. Licensed under the Apache License, Version 2.0."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. "
        "Licensed under the MIT License. Released under the MIT License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. Licensed under the BSD 3-Clause License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This work is licensed under the GNU General Public License, version 3."
    ),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, version 3. This work is licensed under the GNU Lesser General Public License, version 3."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/. Licensed under the Mozilla Public License, version 2.0."
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0."
    ),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Licensed under CC BY-NC 4.0."
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work. Released under CC0 1.0. Public domain.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. Licensed under the ISC License.",
    "Proprietary": "Copyright. All rights reserved. No part of this work may be reproduced without permission. Proprietary and confidential.",
}

CUE = r"(?i)licen[sc]|copyright|permission|rights reserved|warrant|redistribut|public domain|creative commons|\bcc[ -]?(?:by|0)|spdx|proprietary"
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_LEVEL = 9


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=None)
def _compressors():
    plain = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False, write_checksum=False)
    with_template = {}
    for name, template in TEMPLATES.items():
        body = " ".join(words(template)).encode()
        raw = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        with_template[name] = zstandard.ZstdCompressor(level=_LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
    return plain, with_template


def reductions(block: str) -> dict[str, float]:
    """By template: the share of the block's compressed size that the template saves."""
    plain, with_template = _compressors()
    body = " ".join(words(block)).encode()
    alone = len(plain.compress(body))
    return {name: 1 - len(c.compress(body)) / alone for name, c in with_template.items()}


def wording_differences(block: str, template: str) -> int:
    """Words of the block that stand outside the longest alignment with the template's words."""
    a, b = words(block), words(template)
    return len(a) - sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def judge(block: str, most_different: float, tried: int) -> tuple[str | None, float, int]:
    """The confirmed template (or none), its size reduction and the words that differ.

    The ``tried`` templates that save most are held against the wording; the one with the fewest differing words
    wins, the larger saving deciding ties.
    """
    n = len(words(block))
    ranked = sorted(reductions(block).items(), key=lambda x: (-x[1], x[0]))[:tried]
    d, _, name, saved = min((wording_differences(block, TEMPLATES[name]), k, name, saved) for k, (name, saved) in enumerate(ranked))
    return (name if n >= 3 and d <= most_different * n else None), saved, d


_CUE = re.compile(CUE)
#: Lines without a cue word that may stand between two lines of one stretch, and that belong to it before and after.
NEAR = 4
#: Words that a notice inside a sentence has at least; one that is a sentence or a line of its own may have three.
LEAST_INSIDE = 8


@lru_cache(maxsize=None)
def _runs() -> dict[str, dict[tuple[str, str, str], list[int]]]:
    """By template: its runs of three words and where they stand."""
    out: dict = {}
    for name, template in TEMPLATES.items():
        w = words(template)
        own = out[name] = {}
        for k in range(len(w) - 2):
            own.setdefault(tuple(w[k:k + 3]), []).append(k)
    return out


def stretches(text: str):
    """Words of each stretch of lines around cue words: ``(word, line, begins, ends)``, the last two where a line or sentence does."""
    lines = text.split("\n")
    cued = [k for k, line in enumerate(lines) if _CUE.search(line)]
    groups: list[list[int]] = []
    for k in cued:
        if groups and k - groups[-1][1] <= NEAR + 1:
            groups[-1][1] = k
        else:
            groups.append([k, k])
    for first, last in groups:
        out = []
        for k in range(max(0, first - NEAR), min(len(lines), last + NEAR + 1)):
            line = lines[k].lower()
            found = list(_WORD.finditer(line))
            for i, m in enumerate(found):
                before = line[found[i - 1].end():m.start()] if i else "."
                after = line[m.end():found[i + 1].start()] if i + 1 < len(found) else "."
                out.append((m.group(), k, bool(re.search(r"[.;:!?\"()*#|]", before)), bool(re.search(r"[.;:!?\"()*#|]", after))))
        yield out


def windows(found: list[str], runs: dict, most_different: float):
    """Windows ``(first, end)`` in which words that stand in runs of a template prevail.

    The words are cut where the template begins anew and where so many other words follow each other that no notice could span them; of
    each part the longest window counts whose other words are ``most_different`` of all at most, and so on beside it.
    """
    places: dict[int, set[int]] = {}
    for i in range(len(found) - 2):
        for at in runs.get(tuple(found[i:i + 3]), ()):
            for k in range(3):
                places.setdefault(i + k, set()).add(at + k)
    gap = most_different / (1 - most_different) * (len(runs) + 3)
    parts: list[list[int]] = []
    reached = -1
    for i in sorted(places):
        later = [p for p in places[i] if p > reached]
        if not parts or not later or i - parts[-1][-1] - 1 > gap:
            parts.append([])
            later = list(places[i])
        reached = min(later)
        parts[-1].append(i)
    for part in parts:
        yield from _longest(part, most_different)


def _longest(hits: list[int], most_different: float):
    """Of places that count, the longest span with few enough others, and those beside it."""
    if not hits:
        return
    # of hits a to b: (b - a + 1) are met of hits[b] - hits[a] + 1 words, so with s(k) = k - share * hits[k] it takes s(b) + 1 - share >= s(a)
    share = 1 - most_different
    s = [k - share * h for k, h in enumerate(hits)]
    lows = []
    for k, x in enumerate(s):
        if not lows or x < s[lows[-1]]:
            lows.append(k)
    best = (0, 0, 0)
    b = len(s) - 1
    highest = sorted(range(len(s)), key=lambda k: s[k])  # for each start the last end that is high enough
    last, ends = -1, {}
    for k in reversed(highest):
        last = max(last, k)
        ends[k] = last
    values = [s[k] for k in highest]
    for a in lows:
        k = bisect.bisect_left(values, s[a] - (1 - share) - 1e-9)
        b = ends[highest[k]]
        if b >= a and hits[b] - hits[a] + 1 > best[0]:
            best = (hits[b] - hits[a] + 1, a, b)
    _, a, b = best
    yield from _longest(hits[:a], most_different)
    yield hits[a], hits[b] + 1
    yield from _longest(hits[b + 1:], most_different)


def notices(text: str, most_different: float, tried: int, keep_all: bool = False) -> list[tuple[int, int, str | None, float, int, int]]:
    """``(line, last_line, license, reduction, n_words, n_different)`` of each notice, in order; none overlap."""
    out = []
    for stretch in stretches(text):
        found = [w for w, *_ in stretch]
        spans = sorted({s for runs in _runs().values() for s in windows(found, runs, most_different)})
        judged = []
        for first, end in spans:
            n = end - first
            whole = stretch[first][2] and stretch[end - 1][3]
            if n < 3 or not (whole or n >= LEAST_INSIDE) or not _CUE.search(" ".join(found[first:end])):
                continue
            name, saved, different = judge(" ".join(found[first:end]), most_different, tried)
            judged.append((name is None, different - n, different, name or "", first, end, saved))
        taken: list[tuple[int, int]] = []
        for lost, gain, different, name, first, end, saved in sorted(judged):
            if (not lost or keep_all) and all(end <= a or first >= b for a, b in taken):
                taken.append((first, end))
                out.append((stretch[first][1], stretch[end - 1][1], None if lost else name, saved, end - first, different))
    return sorted(out, key=lambda x: x[:2])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_different: float = 0.15, tried: int = 4, keep_all: bool = False) -> DataFrame:
    """``id, line, last_line, license, reduction, n_words, n_different`` for each confirmed notice (with ``keep_all``: each candidate block).

    Null and empty texts have no notices; null ids and repeated rows have their notices like any other; of several
    templates with equal savings the first by name is tried first. Texts are read whole, in time that follows their length. Other
    columns of ``docs`` are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    cued = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(CUE))
    kinds = [("line", T.IntegerType()), ("last_line", T.IntegerType()), ("license", T.StringType()), ("reduction", T.DoubleType()), ("n_words", T.IntegerType()), ("n_different", T.IntegerType())]
    out = T.StructType([cued.schema["id"], *(T.StructField(*k) for k in kinds)])
    arrow = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            rows = [(k, *found) for k, t in enumerate(b.column(1).to_pylist()) for found in notices(t, most_different, tried, keep_all)]
            at, *columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, arrow))], out.names)

    return cued.mapInArrow(run, out)


def op1(docs: DataFrame) -> DataFrame:
    """All confirmed notices of all documents."""
    return scan(docs).withColumnRenamed("id", "doc_id")
