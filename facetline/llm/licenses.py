"""License scans by conditional compression: each template is a raw dictionary, and the best ones are read word by word."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from facetline.llm.common import by_batch, read

#: (license, how texts grant it): fixed values, the public wording of notices and headers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
HINT = re.compile(r"licen[sc]|copyright|all rights reserved|permission (?:is hereby|to use)|redistribut|public domain|free software|creative commons|\bcc[ -](?:by|0)", re.I)
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", re.I)
#: Longer lines are read as several of so many words; the lines of such a length that a block has at most.
WRAP = 30
LINES = 8
#: Lines without a hint that a block may hold between two that have one.
BETWEEN = 2
#: Of the words of a template, how many may differ in the text; words that tell licenses apart may not (fixed values).
DIFFERENCE = 0.1
TELLING = re.compile(r"^(?:v?[0-9.]+|not|no|non.*|nd|nc|sa|by|by-.*|lesser|affero|general|mit|isc|bsd|apache|mozilla|gnu|cc|cc0|2-clause|3-clause|clause|all|reserved)$", re.I)


def wrapped(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, those of more than WRAP words cut into several, and which line of the text each is of."""
    out, of = [], []
    for i, line in enumerate(text.split("\n")):
        at = [m.start() for m in WORD.finditer(line)][::WRAP] if len(line) > WRAP else []
        cuts = [0, *at[1:], len(line)]
        out += [line[x:y] for x, y in zip(cuts, cuts[1:], strict=False)] or [line]
        of += [i] * (len(out) - len(of))
    return out, of


def blocks(lines: list[str]) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the runs of lines that speak of licenses, of at most LINES lines each."""
    runs: list[list[int]] = []
    for i in (i for i, x in enumerate(lines) if HINT.search(x)):
        if runs and i - runs[-1][1] <= BETWEEN + 1 and i - runs[-1][0] < LINES:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(a, b, "\n".join(lines[a : b + 1])) for a, b in runs]


def around(lines: list[str], a: int, b: int, most: int) -> tuple[int, int, str]:
    """(first line, last line, text) of lines a to b with as many words as a notice may have on each side of them."""
    before, after, left = [], [], most
    lo, hi = a, b
    while lo > 0 and left > 0:
        lo -= 1
        at = [m.start() for m in WORD.finditer(lines[lo])]
        before.append(lines[lo][at[-left] :] if len(at) > left else lines[lo])
        left -= len(at)
    left = most
    while hi + 1 < len(lines) and left > 0:
        hi += 1
        at = [m.end() for m in WORD.finditer(lines[hi])]
        after.append(lines[hi][: at[left - 1]] if len(at) > left else lines[hi])
        left -= len(at)
    return lo, hi, "\n".join([*before[::-1], *lines[a : b + 1], *after])


def words(text: str) -> list[str]:
    return [w.lower().rstrip(".") for w in WORD.findall(text)]


def wording(template: list[str], text: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the text lacks, and words that the text has between those that it shares."""
    ops = difflib.SequenceMatcher(None, template, text, autojunk=False).get_opcodes()
    inside = [o for o in ops if o[0] != "insert" or 0 < o[1] < len(template)]
    gone = [w for _, i, j, _, _ in (o for o in inside if o[0] in ("delete", "replace")) for w in template[i:j]]
    edge = {0, len(template)}
    put = [w for tag, i, j, k, m in inside if tag == "insert" or (tag == "replace" and not (i in edge or j in edge)) for w in text[k:m]]
    return gone, put


class Scanner:
    def __init__(self) -> None:
        import zstandard as z

        self.plain = z.ZstdCompressor(level=19, write_content_size=False)
        self.with_dict = [z.ZstdCompressor(level=19, write_content_size=False, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for _, t in TEMPLATES]
        self.words = [words(t) for _, t in TEMPLATES]
        self.bags = [Counter(w) for w in self.words]
        self.most = int((1 + DIFFERENCE) * max(map(len, self.words))) + 1
        self.seen: dict[str, list[tuple]] = {}

    def text(self, text: str) -> list[tuple[int, str, float, list[str], list[str]]]:
        """(line, license, saving, missing, added) of each block as it is; then, with the words around it, of licenses
        that no block there has granted: notices are wrapped, and not each of their lines speaks of licenses."""
        if not HINT.search(text):
            return []
        lines, of = wrapped(text)
        runs = blocks(lines)
        out, granted = [], []
        for a, b, x in runs:
            for r in self.block(x):
                out.append((of[a], *r))
                granted.append((a, b, r[0]))
        for a, b, x in runs:
            lo, hi, wide = around(lines, a, b, self.most)
            for r in self.block(wide) if wide != x else []:
                if not any(r[0] == name and lo <= d and c <= hi for c, d, name in granted):
                    out.append((of[a], *r))
                    granted.append((lo, hi, r[0]))
        return sorted(out, key=lambda r: r[0])

    def block(self, text: str) -> list[tuple[str, float, list[str], list[str]]]:
        """(license, share of the compressed size that the template saves, words gone, words put in) of what a block
        grants: templates by falling saving, confirmed by wording; at most one of each license."""
        if text in self.seen:
            return self.seen[text]
        raw = text.encode()
        own, out, taken = words(text), [], set()
        bag = Counter(own)
        # others lack too many words to be confirmed
        near = [i for i, w in enumerate(self.words) if sum((self.bags[i] - bag).values()) <= DIFFERENCE * len(w)]
        base = len(self.plain.compress(raw)) if near else 0
        ranked = sorted(((1 - len(self.with_dict[i].compress(raw)) / base, i) for i in near), key=lambda x: (-x[0], x[1]))
        for saved, i in ranked:
            name = TEMPLATES[i][0]
            if name in taken:
                continue
            # the stretch of the text that is closest to the template
            m = difflib.SequenceMatcher(None, self.words[i], own, autojunk=False).find_longest_match()
            lo = max(0, m.b - m.a - 3)
            gone, put = wording(self.words[i], own[lo : m.b + len(self.words[i]) - m.a + 3])
            if len(gone) + len(put) <= DIFFERENCE * len(self.words[i]) and not any(TELLING.match(w) for w in gone + put):
                taken.add(name)
                out.append((name, saved, gone, put))
        if len(self.seen) > 10_000:
            self.seen.clear()
        self.seen[text] = out
        return out


_scanner: list[Scanner] = []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (of the block's start, from 0), license, saving, missing, added: one row per license that a block of
    lines grants. saving is the share by which the template, given to zstandard as a raw dictionary, shortens the
    compressed block; missing and added are the words by which the text differs from the template.

    Null and empty texts, and texts without a word about licenses, give no rows; repeated rows give their rows again.
    Whole texts are read; lines of more than WRAP words count as several. A block ends where more than two lines say
    nothing of licenses, or after LINES lines, and is also read with the words around it, as many as the longest template
    has, for licenses that it does not grant alone: so results do not depend on how long lines are. One narrow pass.
    """

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        if not _scanner:
            _scanner.append(Scanner())
        rows = [(doc, *r) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for r in _scanner[0].text(t)]
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "line", "license", "saving", "missing", "added"])

    slim = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return by_batch(slim, fn, "doc_id bigint, line int, license string, saving double, missing array<string>, added array<string>")


def op8_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
