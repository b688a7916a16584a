"""License scans by conditional compression.

Each template has anchors: its longest words (as a rule the rarest; then those in the fewest templates),
just so many that a text that lacks all of them lacks more than ``MAX_MISSING`` of the
template.  A candidate block is a line that holds an anchor with the lines around it, up
to a blank line or as many words as the longest template's window on either side.
Blocks that meet are judged together, and each line with an anchor counts.

Every place of an anchor in a block sets a window for the anchor's template: where the
template would lie, with an eighth of its words more on either side.  The window is
compressed with zstandard twice: alone, and with the template as a raw dictionary.  The
reduction in size, as a share of the size alone, must reach ``MIN_REDUCTION``.  The
windows of all templates are ranked by the bytes saved and, in that order, confirmed by
their exact wording: the words of window and template are aligned, and at most
``MAX_MISSING`` of the template's words may be missing or changed.  The differing
words are part of the result.  Of a template's windows on one place the one with the
fullest wording stands, and a confirmed span stays if it overlaps none of another
template that saved more.

Templates are a parameter; the default lists short notices and headers of
common licences and two short licences whole.  The scan is one pass without a shuffle; templates are a fixed
small list in the task's code.

Defined cases: null and empty texts have no blocks; of overlapping spans that saved
equally the one with the fewest differences stays, then the earlier, the first template
name; a template without a word, or of one so short that the dictionary saves too
little, is never found; blocks whose templates are not confirmed count as
candidates only; repeated rows give repeated rows; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, per_worker, sliced, table

# Public licence notices and headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-full": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
LEVEL = 3
MIN_REDUCTION = 0.25
MAX_MISSING = 0.2


def apart(spans: list[dict]) -> list[dict]:
    """The spans, in order, that overlap none before."""
    starts: list[int] = []  # of the spans taken, sorted
    ends: list[int] = []
    out = []
    for r in spans:
        i = bisect_left(starts, r["end"])
        if i == 0 or ends[i - 1] <= r["start"]:
            starts.insert(i, r["start"])
            ends.insert(i, r["end"])
            out.append(r)
    return out


def anchors(said: list[str], shared: Counter) -> dict[str, list[int]]:
    """The longest words with their places in the template, one place more than may be missing."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(said):
        places.setdefault(w, []).append(i)
    out: dict[str, list[int]] = {}
    left = int(MAX_MISSING * len(said)) + 1
    for w in sorted(places, key=lambda w: (-len(w), shared[w], w)):
        if left <= 0:
            break
        out[w] = places[w]
        left -= len(places[w])
    return out


class Scanner:
    """Templates with their compressors, words and anchors."""

    def __init__(self, templates: dict[str, str]):
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        told = [(name, said.lower(), WORD.findall(said.lower())) for name, said in sorted(templates.items())]
        shared = Counter(w for _, _, said in told for w in set(said))
        self.known = []
        for name, text, said in told:
            if said:
                raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.known.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw), said, anchors(said, shared)))
        self.longest = max((len(w) for _, _, w, _ in self.known), default=0)
        every = {w for *_, marks in self.known for w in marks}
        self.cues = sorted(w for w in every if not any(v != w and v in w for v in every))  # those inside others tell enough

    def told(self, text: str) -> bool:
        return any(w in text for w in self.cues)

    def blocks(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """(number of lines with an anchor, (start, end) of the blocks around them, merged where they meet)."""
        lines = text.split("\n")
        at = [0, *accumulate(len(x) + 1 for x in lines)]
        cues = [i for i, x in enumerate(lines) if self.told(x.lower())]
        reach = self.longest * 5 // 4 + 2

        def beyond(i: int, step: int) -> int:
            words = 0
            while 0 <= i + step < len(lines) and lines[i + step].strip() and words < reach:
                i += step
                words += len(WORD.findall(lines[i]))
            return i

        out: list[tuple[int, int]] = []
        for i in cues:
            first, last = at[beyond(i, -1)], at[beyond(i, 1) + 1] - 1
            if out and first <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return len(cues), out

    def windows(self, here: list[str], said: list[str], marks: dict[str, list[int]], places: dict[str, list[int]]) -> set[tuple[int, int]]:
        """(first, end) word numbers of the windows where the template would lie by one of its anchors."""
        slack = len(said) // 8 + 1
        starts = {j - i for w, own in marks.items() for j in places.get(w, ()) for i in own}
        return {(max(0, x - slack), min(len(here), x + len(said) + slack)) for x in starts}

    def judge(self, block: str) -> list[dict]:
        """Confirmed templates of one block in order, with offsets in the block."""
        words = list(WORD.finditer(block))
        here = [m[0].lower() for m in words]
        places: dict[str, list[int]] = {}
        for j, w in enumerate(here):
            places.setdefault(w, []).append(j)
        ranked, alone = [], {}
        for name, packer, said, marks in self.known:
            for first, end in self.windows(here, said, marks, places):
                if (first, end) not in alone:
                    part = block[words[first].start() : words[end - 1].end()].lower().encode()
                    alone[first, end] = (part, len(self.alone.compress(part)))
                part, size = alone[first, end]
                saved = size - len(packer.compress(part))
                if saved >= MIN_REDUCTION * size:
                    ranked.append((-saved, first, end, name, said, saved / size))
        confirmed = []
        for saved, first, end, name, said, gain in sorted(ranked):
            cut, seen_words = words[first:end], here[first:end]
            same = [m for m in SequenceMatcher(None, said, seen_words, autojunk=False).get_matching_blocks() if m.size]
            missing = len(said) - sum(m.size for m in same)
            if not same or missing > MAX_MISSING * len(said):
                continue
            low, high = same[0].b, same[-1].b + same[-1].size - 1
            kept = {i for m in same for i in range(m.a, m.a + m.size)}
            seen = {i for m in same for i in range(m.b, m.b + m.size)}
            confirmed.append((saved, {
                "template": name, "start": cut[low].start(), "end": cut[high].end(), "reduction": round(gain, 6),
                "missing": [w for i, w in enumerate(said) if i not in kept],
                "added": [seen_words[i] for i in range(low, high + 1) if i not in seen],
            }))
        # of one template's windows on one place the one with the fullest wording
        confirmed.sort(key=lambda x: (len(x[1]["missing"]), len(x[1]["added"]), x[0], x[1]["start"], x[1]["end"]))
        best = []
        for name, *_ in self.known:
            saved_by = {id(r): saved for saved, r in confirmed if r["template"] == name}
            best += [(saved_by[id(r)], r) for r in apart([r for _, r in confirmed if r["template"] == name])]
        best.sort(key=lambda x: (
            x[0], len(x[1]["missing"]) + len(x[1]["added"]), x[1]["start"], x[1]["end"], x[1]["template"]
        ))
        return sorted(apart([r for _, r in best]), key=lambda r: r["start"])

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """(number of candidate blocks, confirmed licences with offsets in the text)."""
        text = text or ""
        if not self.told(text.lower()):
            return 0, []
        n, blocks = self.blocks(text)
        found = [
            r | {"start": r["start"] + start, "end": r["end"] + start}
            for start, end in blocks for r in self.judge(text[start:end])
        ]
        return n, found


FOUND = "array<struct<template: string, start: long, end: long, reduction: double, missing: array<string>, added: array<string>>>"
KIND = pa.list_(pa.struct([
    ("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()),
    ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())),
]))


def _scan(templates: dict[str, str]):
    key = f"licences-{hash(tuple(sorted(templates.items())))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker(key, lambda: Scanner(templates))
        for b in sliced(batches):
            found = [scanner.scan(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array([n for n, _ in found], pa.int64()), pa.array([f for _, f in found], KIND)],
                names=[*b.schema.names[1:], "n_blocks", "licenses"],
            )

    return run


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``keep`` with ``n_blocks`` and ``licenses`` (template, offsets, size reduction, wording differences)."""
    rows = docs.select(F.col(text), *keep)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_batches(rows, _scan(TEMPLATES if templates is None else templates), f"{kind}, n_blocks long, licenses {FOUND}")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(
        "doc_id", "n_blocks", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses.template", ",").alias("templates"), "licenses",
    )
