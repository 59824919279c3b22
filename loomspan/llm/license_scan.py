"""License scan: TF-IDF cosine to templates, then inheritance along directories.

Own license: every line of a text (a header may stand anywhere), runs of lines
(a wrapped header) and the text as a whole (a licence file) are compared with
each template by the cosine of their TF-IDF vectors.  Templates are short
notices, standard headers and titles, and the full licence texts of the folder
``licenses``.  The idf of the templates' words comes from counts over all
documents; any other word has the idf of an unseen word.  Every line that holds
a template word is compared (any other has cosine 0), however many documents
have that word; the vectors are sparse throughout.

Runs: from each line on, for each template of RUN_WORDS words at most, the
shortest run that has as many words as the template, or all that is left.  A run is
scored if an upper bound of its cosine reaches ``least``: the dot product is
exact, a sum over word occurrences, and repeats can only make the norm larger.
Longer texts are found as whole files, and anywhere by their titles.

Inherited license: a licence file (by its name, or as a whole like a template)
licenses its directory; a document without a license of its own gets that of
its nearest ancestor directory, found by joining the ancestors of the distinct
directories with the licensed ones, not by climbing for each document.

Defined results: null text has no license; null path has no directory; of
equally good templates the first by name counts, of equally good lines the
first, of equally good files of a directory the one with the smallest path.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import hashing as H
from loomspan.llm.common import materialise

# fixed values: short notices by which public licenses are named
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute this software is granted under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
# standard titles and file headers, as the licenses' authors give them
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_GNU_REST = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details. You should have received a copy of the GNU {2}General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."


def _gnu(*kind: str) -> list[str]:
    return [_GNU.format(*kind), (_GNU + _GNU_REST).format(*kind)]


HEADERS = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International Public License", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International Public License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu("program", ";", "", ";", "2")],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("program", ":", "", ",", "3")],
    "ISC": ["ISC License", "ISC License (ISC)"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_gnu("library", ";", "Lesser ", ";", "2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("library", ":", "Lesser ", ",", "3")],
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
RUN_WORDS = 300
LEAST = 0.8
SALTS = 16
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\.[a-z]+)?$"


def all_templates() -> dict[str, list[str]]:
    """Notices, headers and full texts by license; read by the driver, workers are sent them."""
    full = {f.stem: f.read_text(encoding="utf-8") for f in (Path(__file__).parent / "licenses").glob("*.txt")}
    return {n: [*([TEMPLATES[n]] if n in TEMPLATES else []), *HEADERS.get(n, []), *([full[n]] if n in full else [])] for n in {*TEMPLATES, *HEADERS, *full}}


class Templates:
    """Sparse vectors of the templates over the hashes of their words."""

    def __init__(self, templates: dict[str, str | list[str]]):
        pairs = [(n, t) for n in sorted(templates) for t in ([templates[n]] if isinstance(templates[n], str) else templates[n])]
        self.names = [n for n, _ in pairs]
        words = next(iter(H.words_of(pa.array([t for _, t in pairs]), H.ALNUM, True, 1 << 30)))
        self.sizes = np.diff(words.doc_off)
        self.vocabulary, at = np.unique(words.hashes, return_inverse=True)
        self.tf = np.zeros((len(self.names), len(self.vocabulary)))
        np.add.at(self.tf, (words.row_of_word(), at), 1)

    def weigh(self, found: np.ndarray, n_docs: int) -> None:
        self.idf = np.log((n_docs + 1) / (found + 1)) + 1
        self.unseen = float(np.log(n_docs + 1) + 1)
        self.vectors = self.tf * self.idf
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True)

    def spot(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, or -1."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def cosines(self, unit: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """units x templates, from (unit, word) pairs."""
        order = np.lexsort((hashes, unit))
        unit, hashes = unit[order], hashes[order]
        new = np.ones(len(unit), dtype=bool)
        new[1:] = (unit[1:] != unit[:-1]) | (hashes[1:] != hashes[:-1])
        first = np.flatnonzero(new)
        tf = np.diff(np.append(first, len(unit)))
        unit, spot = unit[first], self.spot(hashes[first])
        weight = tf * np.where(spot >= 0, self.idf[spot], self.unseen)
        norm = np.sqrt(np.bincount(unit, weights=weight**2, minlength=n))
        known = spot >= 0
        unit, spot, weight = unit[known], spot[known], weight[known]
        out = np.zeros((n, len(self.names)))
        for t in range(len(self.names)):
            out[:, t] = np.bincount(unit, weights=weight * self.vectors[t][spot], minlength=n)
        return out / np.maximum(norm, 1e-12)[:, None]

    def runs(self, spot: np.ndarray, line: np.ndarray, row: np.ndarray, doc_off: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one words of the runs of lines whose cosine to a template may reach least."""
        nothing = np.empty(0, np.int64)
        if not len(line):
            return nothing, nothing
        known = spot >= 0
        begins = np.flatnonzero(np.append(True, line[1:] != line[:-1]))  # lines with words
        stops = np.append(begins[1:], len(line))
        of_word = np.cumsum(np.append(False, line[1:] != line[:-1]))
        square = np.append(0, np.cumsum(np.where(known, self.idf[spot], self.unseen) ** 2))
        last = doc_off[row[begins] + 1] - 1  # the row's last word
        places, known_spot = np.append(0, np.cumsum(known)), spot[known]
        a, b = [], []
        for t in np.flatnonzero(self.sizes <= RUN_WORDS):
            end = stops[of_word[np.minimum(begins + self.sizes[t] - 1, last)]]
            dot = np.append(0, np.cumsum((self.idf * self.vectors[t])[known_spot]))
            bound = (dot[places[end]] - dot[places[begins]]) / np.sqrt(square[end] - square[begins])
            some = (end > stops) & (bound >= least - 1e-6)
            a.append(begins[some])
            b.append(end[some])
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.empty((2, 0), np.int64)
        return both[0], both[1]

    def best_runs(self, a: np.ndarray, b: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best template and cosine of each run of words, some runs at a time."""
        best, top = np.zeros(len(a), np.int64), np.zeros(len(a))
        cut = np.cumsum(b - a) // (1 << 17)
        for k in np.unique(cut):
            at = np.flatnonzero(cut == k)
            size = b[at] - a[at]
            unit = np.repeat(np.arange(len(at)), size)
            word = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a[at], size)
            cos = np.round(self.cosines(unit, hashes[word], len(at)), 9)
            best[at] = cos.argmax(axis=1)
            top[at] = cos.max(axis=1)
        return best, top


def _found(templates: dict[str, str | list[str]]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates)
        counts, n = np.zeros(len(t.vocabulary), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for words in H.words_of(batch.column(0), H.ALNUM, True):
                spot = t.spot(words.hashes)
                some = np.flatnonzero(spot >= 0)
                pairs = np.unique(words.row_of_word()[some] * len(t.vocabulary) + spot[some])
                counts += np.bincount(pairs % len(t.vocabulary), minlength=len(t.vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(counts)), pa.int32()), pa.array(np.concatenate([[n], counts]))], names=["slot", "n"])

    return of


def _scored(text: str, kept: list[str], model, least: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Templates = model.value
        names = np.array(t.names, dtype=object)
        for batch in batches:
            own, score, line_no, whole = [], [], [], []
            for words in H.words_of(batch.column(batch.schema.get_field_index(text)), H.ALNUM, True):
                n = words.n_rows
                row = words.row_of_word()
                feeds = np.flatnonzero(words.raw == 10)
                # lines are numbered through the slice; a row's first line is its own
                line = np.searchsorted(feeds, words.starts) + row
                base = np.searchsorted(feeds, words.at[:-1]) + np.arange(n)
                spot = t.spot(words.hashes)
                marked = np.zeros(len(feeds) + n + 1, dtype=bool)
                marked[line[spot >= 0]] = True
                some = np.flatnonzero(marked[line])
                units, unit = np.unique(line[some], return_inverse=True)
                cos = t.cosines(unit, words.hashes[some], len(units))
                cos = np.round(cos, 9)
                best = cos.argmax(axis=1) if len(units) else np.empty(0, np.int64)
                top = cos[np.arange(len(units)), best]
                unit_row = np.searchsorted(base, units, side="right") - 1
                run_a, run_b = t.runs(spot, line, row, words.doc_off, least)
                run_best, run_top = t.best_runs(run_a, run_b, words.hashes)
                good = run_top >= least
                run_a, run_best, run_top = run_a[good], run_best[good], run_top[good]
                # the whole text: a row without a template word has cosine 0
                has = np.zeros(n, dtype=bool)
                has[unit_row] = True
                mine = np.flatnonzero(has[row])
                rows, which = np.unique(row[mine], return_inverse=True)
                full_cos = np.round(t.cosines(which, words.hashes[mine], len(rows)), 9) if len(rows) else np.zeros((0, len(names)))
                full_best = full_cos.argmax(axis=1)
                full = np.zeros(n)
                full[rows] = full_cos[np.arange(len(rows)), full_best]
                # candidates: lines, runs, whole texts
                kind = np.repeat([0, 1, 2], [len(units), len(run_a), len(rows)])
                c_row = np.concatenate([unit_row, row[run_a], rows])
                c_line = np.concatenate([units - base[unit_row], line[run_a] - base[row[run_a]], np.zeros(len(rows), np.int64)])
                c_top, c_best = np.concatenate([top, run_top, full[rows]]), np.concatenate([best, run_best, full_best])
                order = np.lexsort((c_line, kind, -c_top, c_row))
                first = np.ones(len(order), dtype=bool)
                first[1:] = c_row[order][1:] != c_row[order][:-1]
                pick = order[first]
                name, value, place = np.full(n, None, dtype=object), np.zeros(n), np.full(n, -1)
                at = c_row[pick]
                value[at], place[at] = c_top[pick], c_line[pick]
                name[at] = names[c_best[pick]]
                name[value < least] = None
                place[value < least] = -1
                whole += full.tolist()
                own += name.tolist()
                score += value.tolist()
                line_no += place.tolist()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(own, pa.string()), pa.array(score, pa.float64()), pa.array([None if p < 0 else p for p in line_no], pa.int64()), pa.array(whole, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "own_license", "score", "line", "file_score"])

    return of


def own_licenses(docs: DataFrame, text: str = "text", least: float = LEAST, templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """The documents (without text) with own_license, score, line (from 0) and file_score."""
    texts = templates or all_templates()
    counted = docs.select(text).mapInArrow(_found(texts), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # a row for each template word
    counts = {r["slot"]: r["n"] for r in counted}
    t = Templates(texts)
    t.weigh(np.array([counts.get(i, 0) for i in range(len(t.vocabulary))]), counts.get(-1, 0))
    model = docs.sparkSession.sparkContext.broadcast(t)
    added = ("own_license", "score", "line", "file_score")
    kept = [c for c in docs.columns if c != text and c not in added]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["own_license string, score double, line long, file_score double"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], text).mapInArrow(_scored(text, kept, model, least), schema)


def _directory(path: str):
    return F.when(F.col(path).isNotNull(), F.regexp_replace(F.col(path), r"/?[^/]*$", ""))


def inherit(scored: DataFrame, path: str = "path", least: float = LEAST) -> DataFrame:
    """own_license or the nearest ancestor directory's: license, and from_dir where it is inherited."""
    placed = scored.withColumn("_dir", _directory(path))
    files = placed.filter(F.col("own_license").isNotNull() & F.col("_dir").isNotNull() & (F.col(path).rlike(FILE_NAME) | (F.col("file_score") >= least)))
    licensed = files.groupBy(F.col("_dir").alias("_up")).agg(F.min_by("own_license", F.struct(-F.col("score"), F.col(path))).alias("_license"))
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = placed.select("_dir").filter("_dir is not null").distinct().withColumn("_up", F.explode(F.array_distinct(ups)))
    # one directory may be above all others, or hold a third of all documents: licensed ones are there once for each salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    above = above.withColumn("_salt", salt("_dir")).join(licensed.select("*", salts), ["_up", "_salt"])
    nearest = above.groupBy("_dir").agg(F.max_by(F.struct("_license", "_up"), F.length("_up")).alias("_near")).select("*", salts)
    joined = placed.withColumn("_salt", salt(path)).join(nearest, ["_dir", "_salt"], "left").drop("_salt")
    inherited = F.col("own_license").isNull() & F.col("_near").isNotNull()
    out = joined.withColumn("license", F.coalesce("own_license", "_near._license")).withColumn("from_dir", F.when(inherited, F.col("_near._up")))
    return out.drop("_dir", "_near")


def scan(docs: DataFrame, text: str = "text", path: str = "path", least: float = LEAST) -> DataFrame:
    """Own and inherited licenses of all documents; the scored table is written once and joined from there."""
    return inherit(materialise(own_licenses(docs, text, least), "licenses"), path, least)
