"""License scan by an exact set-similarity join with license templates.

A block is a run of consecutive lines that each have a word: one line of any length, or several that hold at most STRETCH
times the template's words, so that notices which wrap are found, behind comment marks too, and words
scattered over a long text are none. It matches a template if it contains at
least THRESHOLD of the template's distinct words; of blocks within one another that match, the smallest are given. The join runs on
paragraphs, the longest runs, as a block can only match if its paragraph does. Words are ordered by how rare they are in
the paragraphs of the whole corpus. With o the words that must be common:
prefix filter: a match holds one of the template's len - o + 1 rarest words;
length filter: a match has at least o words of the templates' vocabulary;
positional filter: at the first common word, what is left of both in that order must still reach o.
In each paragraph that passes and is verified, two pointers over its lines give the smallest blocks, so the result is exact.

Two passes over the texts: one counts the vocabulary's words in all paragraphs, one joins. Templates are a
parameter and travel to the workers; they do not grow with the corpus.

Defined cases: null and empty texts have no blocks; lines count from 0, empty ones too; a word repeated in a
block counts once towards the overlap, each time towards its length; templates without words match nothing; repeated rows match each; very long lines are
blocks as others; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import col

THRESHOLD = 0.8
STRETCH = 2

TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "licensed under the GNU Lesser General Public License",
    "agpl": "licensed under the GNU Affero General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0",
    "cc-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "reserved": "All rights reserved",
    "mit-grant-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
}


def tokens(text: str) -> list[str]:
    """Distinct words in order of first place."""
    col_ = words.column(pa.array([text]))
    return list(dict.fromkeys(bytes(col_.data[s:e]).decode() for p in words.pieces(col_) for s, e in zip(p.start, p.end)))


def length(text: str) -> int:
    """Words, repeated ones too."""
    return sum(len(p.start) for p in words.pieces(words.column(pa.array([text]))))


def need(size: int, threshold: float = THRESHOLD) -> int:
    """Words of a template of that size that a match must hold."""
    return max(1, math.ceil(threshold * size - 1e-9))


class Index:
    """Templates over the vocabulary in its global order, and the inverted lists of their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[int, int], threshold: float):
        sets = {name: [words.word_hash(w) for w in tokens(t)] for name, t in sorted(templates.items())}
        sets = {name: s for name, s in sets.items() if s}
        self.names = list(sets)
        vocabulary = sorted({h for s in sets.values() for h in s}, key=lambda h: (counts.get(h, 0), h))
        rank = {h: i for i, h in enumerate(vocabulary)}
        self.hash = np.array(sorted(vocabulary), np.uint64)
        self.rank = np.array([rank[int(h)] for h in self.hash], np.int64)
        self.size = np.array([len(s) for s in sets.values()], np.int64)
        self.need = np.array([need(n, threshold) for n in self.size], np.int64)
        self.words = np.array([length(templates[n]) for n in self.names], np.int64)
        self.holds = np.zeros((len(vocabulary), len(sets)), np.int32)
        #: Place of a word in a template's prefix, or -1.
        self.prefix = np.full((len(vocabulary), len(sets)), -1, np.int64)
        for k, s in enumerate(sets.values()):
            order = sorted(rank[h] for h in s)
            self.holds[order, k] = 1
            for i, r in enumerate(order[: len(order) - self.need[k] + 1]):
                self.prefix[r, k] = i


class Hits(NamedTuple):
    """Words of the vocabulary in order: row, paragraph (by its first line), rank and line (by its place among all lines with words)."""

    doc: np.ndarray
    paragraph: np.ndarray
    rank: np.ndarray
    line: np.ndarray


class Lines(NamedTuple):
    """Number in its text, first and last word of every line that has a word."""

    number: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _hits(b: words.Batch, index: Index) -> tuple[Hits, Lines]:
    if not len(b.hash):
        none = np.zeros(0, np.int64)
        return Hits(none, none, none, none), Lines(none, none, none)
    base, end = int(b.col.offsets[0]), int(b.col.offsets[-1])
    line_ends = np.flatnonzero(b.col.data[base:end] == 10) + base
    number = np.searchsorted(line_ends, b.start) - np.searchsorted(line_ends, b.col.offsets[:-1])[b.doc]
    other = b.doc[1:] != b.doc[:-1]
    step = np.diff(number)
    first = np.flatnonzero(np.concatenate([[True], other | (step != 0)]))
    line = np.zeros(len(number), np.int64)
    line[first[1:]] = 1
    line = np.cumsum(line)
    new = np.concatenate([[True], (other | (step > 1))[first[1:] - 1]])
    paragraph = number[first][new][np.cumsum(new) - 1]
    k, known = words.member(b.hash, index.hash)
    at = np.flatnonzero(known)
    return Hits(b.doc[at], paragraph[line[at]], index.rank[k[at]], line[at]), Lines(number[first], first, np.append(first[1:], len(number)) - 1)


def _sets(h: Hits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, paragraph and rank of the paragraphs' words, each once, in that order."""
    rows = np.unique(np.stack([h.doc, h.paragraph, h.rank], 1), axis=0) if len(h.doc) else np.zeros((0, 3), np.int64)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _smallest(line: np.ndarray, rank: np.ndarray, enough: int) -> Iterator[tuple[int, int, int]]:
    """(first line, last line, words in common) of each run of lines that holds enough of the words and no smaller run that does."""
    by: list[tuple[int, list[int]]] = []
    for a, r in zip(line.tolist(), rank.tolist()):
        if by and by[-1][0] == a:
            by[-1][1].append(r)
        else:
            by.append((a, [r]))
    held: Counter = Counter()
    left, given = 0, -1
    for last, ranks in by:
        held.update(ranks)
        while len(held) >= enough:
            rest = held.copy()
            rest.subtract(by[left][1])
            rest = +rest
            if len(rest) < enough:
                break
            held, left = rest, left + 1
        if len(held) >= enough and left > given:
            given = left
            yield by[left][0], last, len(held)


def join(texts: pa.Array, index: Index) -> tuple[np.ndarray, ...]:
    """Row, first line, number of lines, template and overlap of every match."""
    found: list[tuple[int, int, int, int, int]] = []
    for b in words.batches(texts):
        hits, lines = _hits(b, index)
        doc, block, rank = _sets(hits)
        if not len(doc):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])]))
        size = np.diff(np.append(begin, len(doc)))
        enough = np.repeat(size >= index.need.min(), size)
        j = np.arange(len(doc)) - np.repeat(begin, size)
        place = np.where(enough[:, None], index.prefix[rank], -1)
        row, template = np.nonzero(place >= 0)
        i, o = place[row, template], index.need[template]
        of = np.repeat(np.arange(len(begin)), size)[row]
        pair = of * len(index.names) + template
        order = np.lexsort((j[row], pair))
        first = order[np.concatenate([[True], np.diff(pair[order]) != 0])] if len(order) else order
        left = 1 + np.minimum(index.size[template] - i - 1, size[of] - j[row] - 1)
        good = first[(size[of[first]] >= o[first]) & (left[first] >= o[first])]
        if not len(good):
            continue
        common = np.add.reduceat(index.holds[rank], begin, axis=0)[of[good], template[good]]
        # The paragraph's words, of which the smallest blocks are made; hits come paragraph after paragraph, as the sets do.
        edge = np.flatnonzero(np.concatenate([[True], (hits.doc[1:] != hits.doc[:-1]) | (hits.paragraph[1:] != hits.paragraph[:-1])]))
        edge = np.append(edge, len(hits.doc))
        for g, t in zip(of[good[common >= o[good]]].tolist(), template[good[common >= o[good]]].tolist()):
            part = slice(edge[g], edge[g + 1])
            mine = index.holds[hits.rank[part], t] > 0
            for a, z, overlap in _smallest(hits.line[part][mine], hits.rank[part][mine], int(index.need[t])):
                if a == z or lines.last[z] - lines.first[a] + 1 <= STRETCH * index.words[t]:
                    found.append((int(hits.doc[part.start]) + b.first, int(lines.number[a]), z - a + 1, t, overlap))
    got = np.array(found, np.int64).reshape(-1, 5)
    return tuple(got[:, k] for k in range(5))


def frequencies(df: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> dict[int, int]:
    """In how many paragraphs of the whole corpus each word of the templates is."""
    index = Index(templates, {}, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.hash), np.int64)
        for batch in batches:
            for b in words.batches(batch.column(0)):
                total += np.bincount(_sets(_hits(b, index)[0])[2], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["rank", "n"])

    rows = df.select(col(text)).mapInArrow(run, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    return {int(h): n for h, n in zip(index.hash[np.argsort(index.rank)], [r.n for r in sorted(rows)])} if rows else {}


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, block (its first line), lines, template, overlap and containment of every match."""
    if not any(tokens(t) for t in templates.values()):
        templates = {}
    index = Index(templates, frequencies(df, text, templates), threshold) if templates else None
    fields = (("block", T.IntegerType()), ("lines", T.IntegerType()), ("template", T.StringType()), ("overlap", T.IntegerType()), ("containment", T.DoubleType()))
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if index is None:
                continue
            row, block, lines, template, overlap = join(batch.column(1), index)
            names = pa.array([index.names[t] for t in template], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(block, pa.int32()), pa.array(lines, pa.int32()), names, pa.array(overlap, pa.int32()), pa.array(overlap / index.size[template])], names=schema.names
            )

    return df.select(col(key), col(text)).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, stretch: int = STRETCH) -> str:
    rows = ", ".join(f"('{name}', '{t}', {len(tokens(text))}, {need(len(tokens(text)), threshold)}, {length(text)})" for name, text in templates.items() for t in tokens(text))
    return f"""
WITH template(name, token, size, need, words) AS (VALUES {rows}), line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents
), said AS (SELECT doc_id, n, regexp_extract_all(lower(line), '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS w FROM line
), placed AS (
  SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY n) AS upto, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS paragraph FROM said
), hit AS (
  SELECT doc_id, paragraph, n, upto, len(w) AS has, name, token, size, need, words FROM (SELECT *, unnest(list_distinct(w)) AS token FROM placed WHERE len(w) > 0) JOIN template USING (token)
), ends AS (SELECT DISTINCT doc_id, paragraph, n, upto, has, name, size, need, words FROM hit
), runs AS (
  SELECT a.doc_id, a.paragraph, a.name, a.size, a.need, a.n AS i, b.n AS j FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND a.paragraph = b.paragraph AND a.name = b.name
  WHERE a.n = b.n OR a.n < b.n AND b.upto - a.upto + a.has <= {stretch} * a.words
), found AS (
  SELECT r.doc_id, r.name, r.i, r.j, r.size, count(DISTINCT token) AS overlap FROM runs r JOIN hit h ON h.doc_id = r.doc_id AND h.paragraph = r.paragraph AND h.name = r.name AND h.n BETWEEN r.i AND r.j
  GROUP BY r.doc_id, r.name, r.i, r.j, r.size, r.need HAVING count(DISTINCT token) >= r.need
)
SELECT doc_id, CAST(i AS INTEGER) AS block, CAST(j - i + 1 AS INTEGER) AS lines, name AS template, CAST(overlap AS INTEGER) AS overlap, overlap::DOUBLE / size AS containment FROM found f
WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.name = f.name AND g.i >= f.i AND g.j <= f.j AND (g.i > f.i OR g.j < f.j))
"""
