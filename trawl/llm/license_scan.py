"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment decides.

Templates are grouped by length. For a group of up to n shingles (n a power of two), a text is cut into
windows of 2n shingles that begin every n, so an occurrence of a template lies in one window as a whole.
Windows and templates have PERMUTATIONS minima; each is a band of its own. A window that holds four fifths of a
template has a Jaccard similarity of at least 0.19 to it, so it shares a band with probability
1 - 0.81**48, above 0.9999. Windows of one shingle (n = 1) are compared by it.
A template of fewer than WORDS words is one shingle of its own length, and is met wherever its words follow each other.
"""

from __future__ import annotations

import functools
import pathlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import ship_package, table
from trawl.llm.words import LETTERS_DIGITS, LOWER, MULTIPLIER, mix, word_hashes

WORDS = 5
CONTAINMENT = 0.8
PERMUTATIONS = 48
BATCH_BYTES = 6_000_000

#: Sentences by which public licenses announce themselves.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is"
    ' distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    ' associated documentation files (the "Software"), to deal in the Software without restriction, including without'
    " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: Short notices and other wordings. The word MIT alone is left out: it is a common German word.
NOTICES = {
    "agpl": "GNU Affero General Public License",
    "agpl-3.0-id": "AGPL-3.0",
    "agplv3": "AGPLv3",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-id": "Apache-2.0",
    "apache-license": "Apache License",
    "artistic-license": "Artistic License",
    "boost-license": "Boost Software License",
    "bsd-2-clause": "BSD 2-Clause",
    "bsd-2-clause-id": "2-Clause BSD",
    "bsd-3-clause": "BSD 3-Clause",
    "bsd-3-clause-id": "3-Clause BSD",
    "bsd-license": "BSD License",
    "cc0": "CC0",
    "cc-attribution": "Creative Commons Attribution",
    "cc-attribution-noncommercial": "Creative Commons Attribution-NonCommercial",
    "cc-attribution-noderivatives": "Creative Commons Attribution-NoDerivatives",
    "cc-attribution-sharealike": "Creative Commons Attribution-ShareAlike",
    "cc-zero": "Creative Commons Zero",
    **{
        f"cc-{kind}-{version}-id": f"CC {kind} {version}"
        for kind in ("by", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa")
        for version in ("2.0", "2.5", "3.0", "4.0")
    },
    "eclipse-license": "Eclipse Public License",
    "gfdl": "GNU Free Documentation License",
    "gpl": "GNU General Public License",
    "gpl-2.0-id": "GPL-2.0",
    "gpl-3.0-id": "GPL-3.0",
    "gplv2": "GPLv2",
    "gplv3": "GPLv3",
    "isc-license": "ISC License",
    "isc-terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "GNU Lesser General Public License",
    "lgpl-2.1-id": "LGPL-2.1",
    "lgpl-3.0-id": "LGPL-3.0",
    "lgpl-library": "GNU Library General Public License",
    "lgplv3": "LGPLv3",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
    " of the Software.",
    "mit-license": "MIT License",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED'
    " TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mozilla-license": "Mozilla Public License",
    "mpl-2.0-id": "MPL-2.0",
    "no-rights-reserved": "No rights reserved.",
    "public-domain": "public domain",
    "some-rights-reserved": "Some rights reserved.",
    "spdx": "SPDX-License-Identifier",
    "unlicense": "Unlicense",
    "wtfpl": "WTFPL",
    "zlib-license": "zlib License",
}
#: Paragraphs of whole license texts with fewer words (headings, addresses) are no templates.
PARAGRAPH_WORDS = 12


@functools.cache
def catalogue() -> dict[str, str]:
    """TEMPLATES, NOTICES and every paragraph of the license texts in ``licenses``, named by text and paragraph."""
    found = TEMPLATES | NOTICES
    for path in sorted((pathlib.Path(__file__).parent / "licenses").glob("*.txt")):
        for i, paragraph in enumerate(re.split(r"\n\s*\n", path.read_text())):
            if len(re.findall("[A-Za-z0-9]+", paragraph)) >= PARAGRAPH_WORDS:
                found[f"{path.stem}:{i:03}"] = paragraph
    return found


def _shingles(hashes: np.ndarray, owner: np.ndarray, texts: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``words`` words in order, and how many each text has. Shorter texts have none."""
    n = max(0, len(hashes) - words + 1)
    code = np.zeros(n, np.uint64)
    for k in range(words):
        code = code * np.uint64(MULTIPLIER) + hashes[k : k + n]
    inside = owner[:n] == owner[words - 1 : words - 1 + n]
    return mix(code[inside]), np.bincount(owner[:n][inside], minlength=texts)


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in ``wanted``, which is sorted."""
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


class Scanner:
    def __init__(self, templates: dict[str, str]):
        #: Names, numbers of shingles, and all shingles in order with the template of each; by words and span.
        self.classes: dict[tuple[int, int], tuple[list[str], np.ndarray, np.ndarray, np.ndarray]] = {}
        groups: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name, text in sorted(templates.items()):
            hashes, owner = word_hashes([text.encode()], LETTERS_DIGITS, LOWER)
            if not len(hashes):
                raise ValueError(f"template {name} has no words")
            words = min(WORDS, len(hashes))
            codes = np.unique(_shingles(hashes, owner, 1, words)[0])
            groups.setdefault((words, 1 << (len(codes) - 1).bit_length()), []).append((name, codes))
        rng = np.random.default_rng(11)
        self.odd = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.minima = {
            kind: [np.unique([self._permute(codes, k).min() for _, codes in group]) for k in range(self._bands(kind[1]))]
            for kind, group in groups.items()
        }
        for kind, group in groups.items():
            totals = np.array([len(codes) for _, codes in group])
            codes, of = np.concatenate([codes for _, codes in group]), np.repeat(np.arange(len(group)), totals)
            order = np.argsort(codes, kind="stable")
            self.classes[kind] = [name for name, _ in group], totals, codes[order], of[order]

    @staticmethod
    def _bands(span: int) -> int:
        return PERMUTATIONS if span > 1 else 1

    def _permute(self, codes: np.ndarray, k: int) -> np.ndarray:
        return ((codes * self.odd[k]) >> np.uint64(32)).astype(np.uint32)

    def scan(self, texts: list[bytes]) -> list[tuple[int, str, float, int, int]]:
        """(text, license, containment, first word of the first best window, windows that hold it)."""
        hashes, owner = word_hashes(texts, LETTERS_DIGITS, LOWER)
        best: dict[tuple[int, str], list] = {}
        for words in sorted({words for words, _ in self.classes}):
            codes, counts = _shingles(hashes, owner, len(texts), words)
            if len(codes):
                self._scan(words, codes, counts, best)
        return [(text, name, *found) for (text, name), found in sorted(best.items())]

    def _scan(self, words: int, codes: np.ndarray, counts: np.ndarray, best: dict[tuple[int, str], list]) -> None:
        """Adds what the windows of shingles of ``words`` words hold to ``best``."""
        begin = np.cumsum(counts) - counts
        grids = {}
        for span in sorted(span for w, span in self.classes if w == words):
            blocks = -(-counts // span)
            first = np.cumsum(blocks) - blocks
            owner = np.repeat(np.arange(len(counts)), blocks)
            starts = begin[owner] + (np.arange(len(owner)) - first[owner]) * span
            grids[span] = owner, starts, np.append(owner[1:] == owner[:-1], False), np.zeros(len(owner), bool)
        for k in range(max(self._bands(span) for span in grids)):
            values = self._permute(codes, k)
            for span, (_, starts, twin, hit) in grids.items():
                if k >= self._bands(span):
                    continue
                low = np.minimum.reduceat(values, starts) if span > 1 else values
                if span > 1:  # a window is its block and the next one of the text
                    after = np.append(low[1:], low[-1:])
                    low = np.where(twin, np.minimum(low, after), low)
                hit |= _among(low, self.minima[words, span][k])
        for span, (owner, starts, _, hit) in grids.items():
            names, totals, known, of = self.classes[words, span]
            for w in np.flatnonzero(hit).tolist():
                text, start = int(owner[w]), int(starts[w])
                window = np.unique(codes[start : min(start + (2 * span if span > 1 else 1), begin[text] + counts[text])])
                left, right = np.searchsorted(known, window), np.searchsorted(known, window, side="right")
                n = right - left
                at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shares = np.bincount(of[at], minlength=len(names)) / totals
                for t in np.flatnonzero(shares >= CONTAINMENT).tolist():
                    held, found = float(shares[t]), best.setdefault((text, names[t]), [0.0, 0, 0])
                    if held > found[0]:
                        found[:2] = held, start - int(begin[text])
                    found[2] += 1


_loaded: dict[int, Scanner] = {}


def _scan(templates: dict[str, str]):
    def run(batches):
        key = hash(tuple(sorted(templates.items())))
        if key not in _loaded:
            _loaded[key] = Scanner(templates)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, start = batch.column("doc_id").to_pylist(), 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held + len(texts[end]) < BATCH_BYTES):
                    held += len(texts[end])
                    end += 1
                found = _loaded[key].scan(texts[start:end])
                columns = list(zip(*[(ids[start + t], *rest) for t, *rest in found], strict=True)) or [()] * 5
                types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "license", "containment", "first_word", "n_windows"]
                )
                start = end

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` and license found in it: doc_id, license, containment, first_word, n_windows.

    Words are runs of ASCII letters and digits, lower-cased. A license is found if a window holds ``CONTAINMENT`` or
    more of its template's five-word shingles (a template of fewer words is one shingle of its own length); containment is the largest share, first_word where the first such
    window begins, n_windows how many windows hold it. A null or empty text has none, nor has one shorter than every template. Whole texts are read;
    repeated rows are scanned one by one; other columns are ignored; an empty table gives an empty result. No shuffle.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan(dict(templates)), "doc_id long, license string, containment double, first_word long, n_windows long")


def op8_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_license_notices(spark, sf_dir):
    """The scan of op8_license_scan, for short notices, other wordings and the paragraphs of whole license texts too."""
    return scan_licenses(table(spark, sf_dir, "documents"), catalogue())


def oracle_sql(templates: dict[str, str] = TEMPLATES) -> str:
    import re

    values = []
    for name, text in sorted(templates.items()):
        words = re.findall("[a-z0-9]+", text.lower())
        own = sorted({" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)})
        span = 1 << (len(own) - 1).bit_length()
        values += [f"('{name}', {span}, {len(own)}, '{s}')" for s in own]
    return f"""
WITH t(license, span, total, shingle) AS (VALUES {", ".join(values)}),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS words FROM documents),
s AS (SELECT doc_id, i - 1 AS i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
hit AS (SELECT doc_id, license, span, total, shingle, i // span AS block FROM s JOIN t USING (shingle)),
win AS (SELECT doc_id, license, total, span, shingle, block FROM hit
        UNION ALL SELECT doc_id, license, total, span, shingle, block - 1 FROM hit WHERE span > 1 AND block > 0),
held AS (SELECT doc_id, license, span, block, count(DISTINCT shingle)::DOUBLE / total AS c FROM win GROUP BY doc_id, license, span, block, total)
SELECT doc_id, license, max(c) AS containment, min(block * span) FILTER (c = top) AS first_word, count(*) AS n_windows
FROM (SELECT *, max(c) OVER (PARTITION BY doc_id, license) AS top FROM held WHERE c >= {CONTAINMENT}) GROUP BY 1, 2
"""
