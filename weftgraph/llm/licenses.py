"""License scan by conditional compression.

Regions of a text around licence words are compressed without help and with each template as a raw zstandard
dictionary. Templates are ranked by the size they save; each is confirmed by its exact wording differences from the
region, so a text that only looks alike is refused.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Wordings of public licences and their notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
MARK = re.compile(r"licen[cs]|spdx|copyright|warrant|redistribut|permission|public domain|free software", re.I)
WORD = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")
#: Words before and after a mark that belong to its region; regions are cut into windows of so many words.
BEFORE, AFTER, WINDOW = 24, 60, 320
#: Words that name a licence or tell its variant. With all words that hold a digit, they must be the same, in
#: the same order, in the template and in the region.
NAMES = set("apache mit mit-0 gnu gpl lgpl agpl general lesser library affero mozilla bsd isc spdx creative commons cc by by-sa by-nc by-nd by-nc-sa by-nc-nd attribution attribution-sharealike attribution-noncommercial attribution-noderivatives sharealike noncommercial noderivatives clear only later".split())
#: The share of a template's words that the region must have in order.
SHARE = 0.9
KEPT = 4096


def _words(text: str) -> list[str]:
    """Words in lower case; a version's trailing .0 doesn't count."""
    return [re.sub(r"(?<=\d)(?:\.0)+$", "", w) for w in WORD.findall(text.lower())]


def _names(words: list[str]) -> list[str]:
    return [w for w in words if w in NAMES or any(c.isdigit() for c in w)]


@lru_cache(maxsize=1)
def _compressors():
    plain = zstandard.ZstdCompressor(level=3)
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            data = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, _words(text), zstandard.ZstdCompressor(level=3, dict_data=data)))
    return plain, out


def _places(words: list[str], have: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of have that may be the wording: where its first word is, with most of its words in order, or the best match."""
    seen = set()
    bag, n = Counter(words), len(words)
    windows = [(i, i + n) for i, w in enumerate(have) if w == words[0] and (bag & Counter(have[i : i + n])).total() >= SHARE * n]
    for lo, hi in [*windows, (0, len(have))]:
        blocks = [b for b in difflib.SequenceMatcher(None, words, have[lo:hi], autojunk=False).get_matching_blocks() if b.size]
        if blocks and sum(b.size for b in blocks) >= SHARE * len(words):
            at = (lo + blocks[0].b, lo + blocks[-1].b + blocks[-1].size)
            if at not in seen:
                seen.add(at)
                yield at


def judge_region(region: str) -> list[tuple[str, float, int, list[str]]]:
    """(licence, share of the compressed size saved, wording differences, those differences) of confirmed templates, best first."""
    plain, templates = _compressors()
    raw = region.lower().encode()
    alone = len(plain.compress(raw))
    saved = sorted(((1 - len(c.compress(raw)) / alone, name, words) for name, words, c in templates), key=lambda x: (-x[0], x[1]))
    have, found, confirmed = _words(region), {}, []
    bag = Counter(have)
    for share, name, words in saved:
        # the words in order can't be more than the words at all
        if (Counter(words) & bag).total() < SHARE * len(words):
            continue
        for lo, hi in _places(words, have):
            ops = difflib.SequenceMatcher(None, words, have[lo:hi], autojunk=False).get_opcodes()
            changes = [f"-{w}" for op, a, b, _, _ in ops if op in ("delete", "replace") for w in words[a:b]]
            changes += [f"+{w}" for op, _, _, c, d in ops if op in ("insert", "replace") for w in have[lo:hi][c:d]]
            # few words may differ, but not a name or a version
            if len(changes) <= len(words) // 10 and _names(words) == _names(have[lo:hi]):
                confirmed.append((len(changes), -share, name, lo, hi, changes))
                break
    # where wordings overlap, the one with the fewest differences is meant
    taken: list[tuple[int, int]] = []
    for n, share, name, lo, hi, changes in sorted(confirmed):
        if all(min(hi, b) - max(lo, a) <= min(hi - lo, b - a) / 2 for a, b in taken):
            taken.append((lo, hi))
            found.setdefault(name, (name, round(-share, 6), n, changes))
    return sorted(found.values(), key=lambda x: (x[2], -x[1], x[0]))


def regions(text: str) -> Iterator[str]:
    """Stretches of the text around licence words, in windows that overlap by half."""
    spots = [(m.start(), m.end()) for m in MARK.finditer(text)]
    joined: list[list[int]] = []
    for a, b in spots:
        lo, hi = max(0, a - 12 * BEFORE), b + 12 * AFTER
        if joined and lo <= joined[-1][1]:
            joined[-1][1] = hi
        else:
            joined.append([lo, hi])
    for lo, hi in joined:
        part = text[lo:hi]
        if len(part) <= 12 * WINDOW:
            yield part
        else:
            for at in range(0, len(part), 6 * WINDOW):
                yield part[at : at + 12 * WINDOW]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, licenses, best, saved, n_differences, differences) for every row: all columns in `row`.

    licenses: the confirmed licences in order of name, empty if none; the others tell of the one with the fewest wording
    differences, then the greatest saving. Null and empty texts have none. Repeated rows each come back.
    """
    small_batches(docs.sparkSession)
    rows, column = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)
    none = F.lit(None)
    schema = rows.select("row", none.cast("array<string>").alias("licenses"), none.cast("string").alias("best"), none.cast("double").alias("saved"), none.cast("int").alias("n_differences"), none.cast("array<string>").alias("differences")).schema

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            out = []
            for text in pc.struct_field(batch.column(0), [column]).to_pylist():
                found: dict[str, tuple] = {}
                for region in regions(text or ""):
                    if (got := known.get(region)) is None:
                        got = judge_region(region)
                        if len(known) < KEPT:
                            known[region] = got
                    for x in got:
                        if x[0] not in found or (x[2], -x[1]) < (found[x[0]][2], -found[x[0]][1]):
                            found[x[0]] = x
                best = min(found.values(), key=lambda x: (x[2], -x[1], x[0]), default=None)
                out.append((sorted(found), *(best or (None, None, None, None))))
            kinds = (pa.list_(pa.string()), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]], names=["row", "licenses", "best", "saved", "n_differences", "differences"])

    return rows.mapInArrow(look, schema)
