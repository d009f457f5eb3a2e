"""License scan by conditional compression.

Candidate blocks are the lines of a text that hold a license word, with neighbouring lines
up to the next such line when it is near. Each block is compressed alone and with each
template as a raw zstandard dictionary; templates are ranked by how much they reduce the
block's size. Winners are confirmed by their exact wording: the template's words are
aligned with the block's, and the missing and added words must stay within a tenth. A
confirmed passage is taken out of the block and the rest is ranked again, so a block
may hold several licenses.

The words that make a line a candidate cannot be lost: every template holds more of
them than a tenth of its words, so a wording that would be confirmed holds at least
one (load() checks this). Null and empty texts have no findings; rows are independent.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import read

TOLERANCE = 0.1
NEAR_LINES = 3
BLOCK_WORDS = 1200
LEAST_GAIN = 0.05

TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 license).",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense license.",
    "All-rights-reserved": "All rights reserved.",
}
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")
_ANY_CASE = re.compile(_WORD.pattern, re.I | re.A)
_KEYS = (
    "licen", "copyright", "reserved", "rights", "permi", "granted", "distribut", "conditions", "disclaimer", "software", "notice", "source", "public", "copies", "gnu", "apache", "mozilla",
    "creative", "domain", "waived", "modif", "binary",
)


def has_key(text: str) -> bool:
    """Whether the text holds a license word, as part of any word."""
    low = text.lower()
    return any(k in low for k in _KEYS)


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    compressor: zstandard.ZstdCompressor
    #: Words that a wording may have in a row without a license word.
    reach: int


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def load(templates: dict[str, str]) -> list[Template]:
    out = []
    for name, text in templates.items():
        own = words_of(text)
        allowed = int(TOLERANCE * len(own))
        keys = [i for i, w in enumerate(own) if has_key(w)]
        if len(keys) <= allowed:
            raise ValueError(f"{name}: too few of its words mark a candidate line")
        marks = [-1, *keys, len(own)]
        reach = max(b - a for a, b in zip(marks, [*marks[allowed + 1 :], *[len(own)] * (allowed + 1)], strict=True)) + allowed
        kind = zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Template(name, tuple(own), zstandard.ZstdCompressor(level=3, dict_data=kind, write_content_size=False, write_dict_id=False), reach))
    return out


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidate blocks, in characters."""
    if not has_key(text):
        return
    open_: list[int] | None = None
    gap, at = 0, 0
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        if has_key(line):
            if open_ is None:
                open_ = [at, end]
            open_[1], gap = end, 0
        elif open_ is not None:
            gap += 1
            if gap > NEAR_LINES:
                yield open_[0], open_[1]
                open_ = None
        at = end
    if open_ is not None:
        yield open_[0], open_[1]


def parts(templates: list[Template], text: str) -> Iterator[list[tuple[str, int, int]]]:
    """The (word, start, end) of the candidate blocks, with the words around them that a wording may have outside key lines."""
    if not has_key(text):
        return
    spans = [(m[0].lower(), m.start(), m.end()) for m in _ANY_CASE.finditer(text)]
    starts = [s for _, s, _ in spans]
    reach = max(t.reach for t in templates)
    merged: list[list[int]] = []
    for x, y in blocks(text):
        low, high = max(0, bisect.bisect_left(starts, x) - reach), bisect.bisect_left(starts, y) + reach
        if merged and low <= merged[-1][1]:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    for low, high in merged:
        yield spans[low:high]
    for x, y in blocks(text):  # then alone, as short templates save too little of a wide block
        yield spans[bisect.bisect_left(starts, x) : bisect.bisect_left(starts, y)]


def ranked(templates: list[Template], words: list[str]) -> list[tuple[float, Template]]:
    """Templates by the share of the block's compressed size that they save."""
    data = " ".join(words).encode()
    alone = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data))
    got = [((alone - len(t.compressor.compress(data))) / alone, t) for t in templates]
    return sorted(got, key=lambda x: (-x[0], -len(x[1].words), x[1].name))


@dataclass
class Match:
    first: int
    last: int
    missing: list[str]
    added: list[str]


def confirm(template: Template, words: list[str]) -> Match | None:
    """The alignment of the template in the words, if its differences stay within the tolerance."""
    allowed = int(TOLERANCE * len(template.words))
    m = difflib.SequenceMatcher(None, template.words, words, autojunk=False)
    anchor = m.find_longest_match()
    if not anchor.size:
        return None
    low = max(0, anchor.b - anchor.a - allowed)
    high = min(len(words), anchor.b - anchor.a + len(template.words) + allowed)
    parts = [x for x in difflib.SequenceMatcher(None, template.words, words[low:high], autojunk=False).get_matching_blocks() if x.size]
    first, last = low + parts[0].b, low + parts[-1].b + parts[-1].size
    hit = {x.a + i for x in parts for i in range(x.size)}
    used = {low + x.b + i for x in parts for i in range(x.size)}
    missing = [w for i, w in enumerate(template.words) if i not in hit]
    added = [words[i] for i in range(first, last) if i not in used]
    return Match(first, last, missing, added) if len(missing) + len(added) <= allowed else None


def scan(templates: list[Template], text: str) -> list[tuple[str, int, int, float, str]]:
    """(license, start, end, gain, differences) of the confirmed licenses, in order; characters of text."""
    out = []
    # every wording lies within one of the overlapping windows
    step = max(BLOCK_WORDS // 2, *(len(t.words) + int(TOLERANCE * len(t.words)) for t in templates))
    seen: set[tuple[int, int]] = set()
    for spans in parts(templates, text):
        todo = [spans[i : i + 2 * step] for i in range(0, max(1, len(spans) - step), step)]
        while todo:
            part = todo.pop()
            own = [w for w, _, _ in part]
            if not own:
                continue
            for gain, t in ranked(templates, own):
                # a short template inside a long block saves little of it: judge the saving against its own size
                if gain * len(own) < LEAST_GAIN * len(t.words):
                    continue
                m = confirm(t, own)
                if m is not None:
                    place = part[m.first][1], part[m.last - 1][2]
                    if not any(a < place[1] and place[0] < b for a, b in seen):
                        seen.add(place)
                        diff = " ".join([*(f"-{w}" for w in m.missing), *(f"+{w}" for w in m.added)])
                        out.append((t.name, *place, round(gain, 6), diff))
                    todo += [part[: m.first], part[m.last :]]
                    break
    return sorted(out, key=lambda f: f[1:3])


_FOUND = "doc_id long, license string, start_char long, end_char long, gain double, exact boolean, differences string"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each confirmed license of each row of docs."""
    given = templates or TEMPLATES
    load(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(given)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for name, x, y, gain, diff in scan(own, text or ""):
                    out.append((doc, name, x, y, gain, not diff, diff))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _FOUND)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
