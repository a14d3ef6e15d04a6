"""License scans (operator 10): an exact set-similarity join of text blocks with license templates.

A template meets a block when the block holds at least the threshold share of the template's distinct words. Every block and
template that meet are found and reported; as templates differ by few words, a block takes its labels from those of
which it holds the largest share, and on ties the most words. One pass counts in how many texts each template word occurs (the vocabulary of the templates bounds that
table); words are ordered by it, rarest first. A template of n words that needs k of them must share one of its first
n - k + 1 words with the block (prefix filter); the block needs at least k distinct words (length filter); and a first
shared word at place i of the template leaves at most n - i shared words (positional filter). What passes is counted
exactly, so that nothing is missed. Blocks are the lines of a text and its paragraphs (runs of lines between blank ones).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches, rare_gc, same_dtype, text_rows

THRESHOLD = 0.8

# The texts of licenses by paragraph, the notices that they ask for, and short statements: (label, text).
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("isc", "Released under the ISC License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
]
# Phrases that count wherever their words stand one after the other, and their labels.
PHRASES: list[tuple[str, str]] = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

_BLANK = re.compile(rb"\n[\x20\x09-\x0D]*\n")
# Bytes that are no ASCII letter or digit become spaces; bytes of other characters stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 10 if b == 10 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


@dataclass
class Template:
    label: str
    words: list[bytes]  # distinct, rarest first
    needed: int
    place: dict[bytes, int] = field(default_factory=dict)

    @property
    def prefix(self) -> list[bytes]:
        return self.words[: len(self.words) - self.needed + 1]


def build(templates: list[tuple[str, str]], threshold: float, frequency: dict[bytes, int]) -> list[Template]:
    out = []
    for label, text in templates:
        words = sorted(set(words_of(text)), key=lambda w: (frequency.get(w, 0), w))
        needed = max(1, math.ceil(threshold * len(words) - 1e-9))
        out.append(Template(label, words, needed, {w: i for i, w in enumerate(words)}))
    return out


class Scanner:
    def __init__(self, templates: list[Template], phrases: list[tuple[str, str]]):
        self.by_prefix: dict[bytes, list[int]] = {}
        for i, t in enumerate(templates):
            for w in t.prefix:
                self.by_prefix.setdefault(w, []).append(i)
        self.prefixes = frozenset(self.by_prefix)
        self.templates = templates
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.firsts = frozenset(p[0] for p, _ in self.phrases)

    def base(self, words: list[bytes], distinct: set[bytes]) -> tuple[list[int], set[str]]:
        starts, labels = [], set()
        for phrase, label in self.phrases:
            if all(w in distinct for w in phrase):
                rare, n = min(enumerate(phrase), key=lambda x: words.count(x[1])), len(phrase)
                at = -1
                for _ in range(words.count(rare[1])):
                    at = words.index(rare[1], at + 1)
                    if at >= rare[0] and words[at - rare[0] : at - rare[0] + n] == phrase:
                        starts.append(at - rare[0])
                        labels.add(label)
        return starts, labels

    def block(self, words: set[bytes]) -> list[tuple[int, float, int]]:
        """The templates that the block holds: (number, share of the template's words, how many these are)."""
        out = []
        for i in {i for w in words & self.prefixes for i in self.by_prefix[w]}:
            t = self.templates[i]
            if len(words) < t.needed:
                continue
            first = min(t.place[w] for w in t.prefix if w in words)
            if len(t.words) - first < t.needed:
                continue
            shared = len(words.intersection(t.words))
            if shared >= t.needed:
                out.append((i, shared / len(t.words), shared))
        return out

    def blocks(self, text: str) -> Iterator[tuple[int, int, set[bytes]]]:
        """Lines, and paragraphs of more than one line: (first byte, bytes, words)."""
        data = text.encode("utf-8", "replace").translate(_WORD_BYTES)
        gaps = [(m.start(), m.end()) for m in _BLANK.finditer(data)]
        for begin, end in zip([0, *(e for _, e in gaps)], [*(s for s, _ in gaps), len(data)], strict=True):
            lines = data[begin:end].split(b"\n")
            at = begin
            for line in lines:
                yield at, len(line), set(line.split())
                at += len(line) + 1
            if len(lines) > 1:
                yield begin, end - begin, set(data[begin:end].split())

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        distinct = set(words)
        starts, base = self.base(words, distinct) if not self.firsts.isdisjoint(distinct) else ([], set())
        labels, score = set(base), 1.0 if starts else 0.0
        # A block's words are the text's: what the whole text does not meet, none of its blocks does.
        if not self.prefixes.isdisjoint(distinct) and self.block(distinct):
            for _, _, block in self.blocks(text):
                found = self.block(block)
                best = max((x[1:] for x in found), default=(0.0, 0))
                labels |= {self.templates[x[0]].label for x in found if x[1:] == best}
                score = max(score, best[0])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def word_frequencies(rows: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the templates occurs; at most one row a word and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in vocabulary.intersection(words_of(text)):
                    totals[w] = totals.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())], ["word", "n"])

    table = rows.select("__text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in table.collect()}


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, phrases: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base (places of the phrases), first_word and last_word (smallest and largest
    start of such a place), base_labels, labels (with those of the templates), score (the largest share of a template found,
    1 where a phrase stands, else 0).

    Null text is empty: no words, no labels (empty strings), score 0. Null ids and repeated rows stay; a block that meets
    several templates gives the labels of those with the largest share and then the most shared words, all of them on
    ties; equal labels count once; whole texts are read however long; an empty table
    gives an empty table; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    templates, phrases = templates if templates is not None else TEMPLATES, phrases if phrases is not None else PHRASES
    rows = text_rows(docs, id_col, text_col)
    frequency = word_frequencies(rows, frozenset(w for _, t in templates for w in words_of(t)))
    built = build(templates, threshold, frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_gc()
        scanner = Scanner(built, phrases)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            if batch.num_rows:
                columns = zip(*map(scanner.scan, batch.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["__id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"__id {same_dtype(rows, '__id')}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def license_blocks(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text block and template that meet: id, first_byte and n_bytes of the block in the UTF-8 text, label, share,
    rank (1 for the largest share of a block, and the most shared words on ties). The cases named at license_scan() hold; texts without a match give no row."""
    bound_batches(docs.sparkSession)
    templates = templates if templates is not None else TEMPLATES
    rows = text_rows(docs, id_col, text_col)
    built = build(templates, threshold, word_frequencies(rows, frozenset(w for _, t in templates for w in words_of(t))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(built, [])
        for batch in batches:
            found = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                for first, n, block in scanner.blocks(text):
                    met = scanner.block(block)
                    found += [(at, first, n, scanner.templates[x[0]].label, x[1], 1 + sum(y[1:] > x[1:] for y in met)) for x in met]
            if found:
                at, *columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32()], strict=True))], ["__id", "first_byte", "n_bytes", "label", "share", "rank"])

    return rows.mapInArrow(run, f"__id {same_dtype(rows, '__id')}, first_byte bigint, n_bytes bigint, label string, share double, rank int").withColumnRenamed("__id", id_col)


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for license_scan() over documents: all blocks against all templates, without filters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate({{}}, '{upper}', '{lower}'), '{word}')"
    quote = lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in sorted(ws)) + "]"
    values = ", ".join(f"('{label}', {quote(set(words_of(text)))})" for label, text in TEMPLATES)
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return f"""
WITH templates(label, tw) AS (VALUES {values}),
phrases(phrase, label, n) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {words.format("t")} AS ws FROM d),
base AS (
  SELECT rid, p.label, i - 1 AS start
  FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_contains(ws, 'license') OR list_contains(ws, 'nc')) x
  JOIN phrases p ON ws[i] = split_part(p.phrase, ' ', 1) AND array_to_string(ws[i : i + p.n - 1], ' ') = p.phrase),
paragraphs AS (SELECT rid, unnest(regexp_split_to_array(t, '\\n[\\x20\\x09-\\x0D]*\\n')) AS b FROM d),
blocks AS (SELECT rid, b FROM paragraphs UNION ALL SELECT rid, unnest(string_split(b, chr(10))) FROM paragraphs),
sets AS (SELECT rid, row_number() OVER () AS bid, list_distinct({words.format("b")}) AS bw FROM blocks),
met AS (
  SELECT rid, bid, label, len(list_intersect(bw, tw)) AS n, len(list_intersect(bw, tw)) / len(tw)::DOUBLE AS share FROM sets, templates
  WHERE len(list_intersect(bw, tw)) >= ceil({threshold} * len(tw) - 1e-9)),
found AS (SELECT rid, label, share FROM (SELECT *, rank() OVER (PARTITION BY bid ORDER BY share DESC, n DESC) AS place FROM met) WHERE place = 1),
b AS (SELECT rid, count(*) AS n, min(start) AS f, max(start) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM found) GROUP BY rid),
s AS (SELECT rid, max(share) AS share FROM found GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.f::BIGINT AS first_word, b.l::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN s USING (rid)"""
