"""Operator 7: license scans by conditional compression.

1. A text is cut into sentences (at line ends and after . ! ? ; :). Sentences that share a run of three words with a template
   are candidates; runs of them, with at most one other sentence between, are candidate blocks.
2. Each block is compressed alone and with each template as a zstandard raw-content dictionary. The share of bytes that a
   template saves ranks the templates.
3. Those that save MIN_SAVED or more are held, in that order, against the exact differences in wording: words are aligned, and the block must have the
   template's words but for ALLOWED of them, missing or extra, in the aligned part; templates of under SHORT words must agree in
   every word; a difference in a number or a negation is never allowed. The first that is confirmed is the block's license, with its differences.

After a confirmed notice the rest of the block, before and after the aligned part, is scanned again. Of a block without a confirmed
notice each sentence is scanned by itself.

Defined results: null and empty texts have no block. Repeated rows are each reported; null doc_ids stay null. Of templates that save
the same, the longer one goes first, then by name. Case, white space and marks don't count as wording. Other columns are ignored.
Every text is scanned whole. Only texts without any of the stems KEYS are passed over: each template has one in ALLOWED parts that can't be missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

SENTENCE = re.compile(r"\n|(?<=[.!?;:])\s+")
KEYS = ("licen", "reserved", "permission", "redistribut", "warrant", "domain")
ALLOWED, SHORT, MIN_SAVED = 0.05, 25, 0.2
NEVER = re.compile(r"^(\d+|no|not|non|without|nor|never|noncommercial|only|later)$")

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (license, kind, wording)
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "permissive",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    (
        "MIT",
        "permissive",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    ("BSD-2-Clause", "permissive", _BSD + _BSD_END),
    (
        "BSD-3-Clause",
        "permissive",
        _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    ),
    (
        "ISC",
        "permissive",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "copyleft",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0-or-later",
        "copyleft",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "MPL-2.0",
        "copyleft",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "Unlicense",
        "public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("all-rights-reserved", "proprietary", "All rights reserved."),
)


@dataclass(frozen=True)
class Template:
    license: str
    kind: str
    words: tuple[str, ...]
    packer: zstandard.ZstdCompressor


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:]))


@cache
def templates() -> tuple[list[Template], frozenset]:
    made = []
    for license_, kind, wording in TEMPLATES:
        ws = words_of(wording)
        raw = zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append(Template(license_, kind, tuple(ws), zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False)))
    return made, frozenset(g for t in made for g in trigrams(list(t.words)))


@cache
def plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)


def ranked(words: list[str]) -> list[tuple[float, Template]]:
    """Templates by the share of bytes that they save of a block, the best first."""
    raw = " ".join(words).encode("utf-8", "surrogatepass")
    alone = len(plain().compress(raw))
    saved = [(1 - len(t.packer.compress(raw)) / alone, t) for t in templates()[0]]
    return sorted((x for x in saved if x[0] >= MIN_SAVED), key=lambda x: (-x[0], -len(x[1].words), x[1].license))


def differences(words: list[str], t: Template) -> tuple[int, int, list[str], list[str]] | None:
    """(begin, end, missing, extra) of the part of words that is worded like the template, or None."""
    m = SequenceMatcher(None, words, t.words, autojunk=False)
    runs = [x for x in m.get_matching_blocks() if x.size]
    if not runs or sum(x.size for x in runs) < (1 - ALLOWED) * len(t.words):
        return None
    # Words that match by chance, far before or after, don't belong to the notice.
    keep = [x for x in runs if abs((x.a - x.b) - (max(runs, key=lambda r: r.size).a - max(runs, key=lambda r: r.size).b)) <= max(2, len(t.words) // 4)]
    begin, end = keep[0].a, keep[-1].a + keep[-1].size
    missing, extra, at = [], [], (begin, 0)
    for x in [*keep, None]:
        to = (x.a, x.b) if x else (end, len(t.words))
        extra += words[at[0] : to[0]]
        missing += t.words[at[1] : to[1]]
        at = (x.a + x.size, x.b + x.size) if x else at
    most = 0 if len(t.words) < SHORT else ALLOWED * len(t.words)
    if len(missing) > most or len(extra) > most or any(map(NEVER.match, missing + extra)):
        return None
    return begin, end, missing, extra


def blocks(text: str) -> Iterator[tuple[int, list[list[str]]]]:
    """(ordinal, words by sentence) of the candidate blocks of a text."""
    low = text.lower()
    if not any(k in low for k in KEYS):
        return
    grams = templates()[1]
    sentences = [ws for x in SENTENCE.split(text) if (ws := words_of(x))]
    flat = [w for ws in sentences for w in ws]
    of = [k for k, ws in enumerate(sentences) for _ in ws]
    hits = sorted({of[k + d] for k, g in enumerate(zip(flat, flat[1:], flat[2:])) if g in grams for d in range(3)})
    n = 0
    while hits:
        m = next((k for k in range(1, len(hits)) if hits[k] > hits[k - 1] + 2), len(hits))
        yield n, sentences[hits[0] : hits[m - 1] + 1]
        hits, n = hits[m:], n + 1


def found_in(words: list[str]) -> Iterator[tuple[float, Template, list[str], list[str]]]:
    """The confirmed notices of a block."""
    for saved, t in ranked(words):
        d = differences(words, t)
        if d:
            begin, end, missing, extra = d
            if begin > 1:
                yield from found_in(words[:begin])
            yield saved, t, missing, extra
            if len(words) - end > 1:
                yield from found_in(words[end:])
            return


def notices(sentences: list[list[str]]) -> list[tuple[float, Template, list[str], list[str]]]:
    whole = list(found_in([w for s in sentences for w in s]))
    return whole or [x for s in sentences if len(sentences) > 1 for x in found_in(s)]


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, block, notice, license, kind, saved, missing, extra): the confirmed notices of all documents."""
    s, n = pa.string(), pa.int32()
    types = [pa.int64(), n, n, s, s, pa.float64(), pa.list_(s), pa.list_(s)]
    names = ["doc_id", "block", "notice", "license", "kind", "saved", "missing", "extra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (i, k, m, t.license, t.kind, round(saved, 6), missing, extra)
                for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist())
                if text
                for k, ws in blocks(text)
                for m, (saved, t, missing, extra) in enumerate(notices(ws))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names)

    schema = "doc_id long, block int, notice int, license string, kind string, saved double, missing array<string>, extra array<string>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
