"""Licence scan: TF-IDF cosine to templates, then inheritance from directories.

Every line of a text and every run of words as long as a notice, across lines, is compared with
the notices, and the text as a whole with the notices and full licence texts, as sparse TF-IDF vectors of words.  A word's weight falls with the number
of documents that have it, counted over all documents, whether a template has it or not: words
that no template has are counted where a line or text may be a notice at their least weight.  A text that is a licence as a whole is a licence file of its directory; rows
without a notice of their own inherit from the nearest directory above them that has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.llm import tokens
from archivemill.llm.shared import staged
from archivemill.llm.tokens import Texts, Words

#: Least cosine of a line and a notice, and of a text and a licence.
HEADER_COSINE = 0.75
FILE_COSINE = 0.6
#: Least cosine of a text and a full licence text, whose common words alone are like those of other long texts.
LICENCE_COSINE = 0.85

#: File names of licences; such a file hands down what its whole text is like, a file of another name only a full licence text.
LICENCE_NAME = r"(?i)(^|/)((un)?licen[cs]es?|copying|notice)([._-][^/]*)?$"

# Wordings of notices and openings of licences, with SPDX names.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
]

_IN_LINE = tokens.table(lambda b: b != 0x0A)


# What the AGPL adds to the text of the GPL 3.
_AFFERO = """Remote Network Interaction; Use with the GNU General Public License.  Notwithstanding any other provision
of this License, if you modify the Program, your modified version must prominently offer all users interacting with it
remotely through a computer network (if your version supports such interaction) an opportunity to receive the
Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge,
through some standard or customary means of facilitating copying of software."""


@lru_cache(maxsize=1)
def licence_texts() -> list[tuple[str, str]]:
    """Full licence texts with SPDX names; read on the driver only."""
    out = [(f.name.removesuffix(".txt"), f.read_text()) for f in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]
    affero = dict(out)["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General")
    return [*out, ("AGPL-3.0", f"{affero}\n{_AFFERO}")]


def _vocabulary(templates: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the templates' words; template and word number of every word in them."""
    column = pa.array([text for _, text in templates], pa.string())
    found = [t.words(tokens.ALNUM, lower=True) for t in tokens.slices(column, 1 << 30)]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(w.hashes for w in found)])
    owner = np.concatenate([np.zeros(0, np.int64), *(w.owner for w in found)])
    vocabulary, number = np.unique(hashes, return_inverse=True)
    return vocabulary, owner, number


def _terms(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Word numbers; -1 for words of no template."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def document_frequencies(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> tuple[np.ndarray, int]:
    """For each word of the templates the number of documents that have it; the number of documents."""
    vocabulary, _, _ = _vocabulary(templates + licence_texts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            totals[-1] += batch.num_rows
            for texts in tokens.slices(batch.column(0)):
                words = texts.words(tokens.ALNUM, lower=True)
                terms = _terms(words.hashes, vocabulary)
                own = np.unique(words.owner[terms >= 0] * len(vocabulary) + terms[terms >= 0])
                totals[:-1] += np.bincount(own % max(len(vocabulary), 1), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals))), pa.array(totals)], names=["term", "n"])

    sums = docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for row in sums.collect():  # one row for each word of the templates
        out[row.term] = row.n
    return out[:-1], int(out[-1])


class Matcher:
    """The templates as unit vectors."""

    def __init__(self, frequencies: np.ndarray, documents: int, templates: list[tuple[str, str]] = TEMPLATES):
        self.notices, self.licences = slice(0, len(templates)), slice(len(templates), None)
        templates = templates + licence_texts()
        self.names = [name for name, _ in templates]
        self.vocabulary, owner, number = _vocabulary(templates)
        self.weights = np.log((1 + documents) / (1 + frequencies)) + 1
        self.documents = documents
        matrix = np.zeros((len(templates), len(self.vocabulary)))
        np.add.at(matrix, (owner, number), self.weights[number])
        self.lengths = np.bincount(owner, minlength=len(templates))
        self.matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def candidates(self, words: Words, unit: np.ndarray, units: int, least: float, whole: bool, rows: slice) -> Iterator[tuple[int, dict]]:
        """Units (lines, runs of words or texts) that reach ``least`` if their other words weigh 1, which is the least weight.

        Each comes with its best template, their dot product, the squared norm of its words of
        templates, and its other words, from whose weights the cosine follows.
        """
        terms = _terms(words.hashes, self.vocabulary)
        keys = tokens.chained([words.hashes, unit.astype(np.uint64)])
        _, first, times = np.unique(keys, return_index=True, return_counts=True)
        term, of = terms[first], unit[first]
        known = term >= 0
        weight = times * np.where(known, self.weights[np.maximum(term, 0)] if len(self.weights) else 0.0, 1.0)
        norm = np.bincount(of, weights=weight**2, minlength=units)
        inside = np.bincount(of[known], weights=weight[known] ** 2, minlength=units)
        names, matrix = self.names[rows], self.matrix[rows]
        own = known.copy()
        own[known] = matrix.any(axis=0)[term[known]]
        shared = np.bincount(of[own], weights=weight[own] ** 2, minlength=units)
        may = (shared > 0) & (shared >= (least - 1e-9) ** 2 * norm)
        if not names or not may.any():
            return
        use = np.flatnonzero(own & may[of])
        row = np.cumsum(may) - 1
        dots = np.zeros((int(may.sum()), len(names)))
        np.add.at(dots, row[of[use]], weight[use, None] * matrix[:, term[use]].T)
        top = dots.argmax(axis=1)
        dot = dots[np.arange(len(top)), top]
        at = np.flatnonzero(may)
        good = dot >= (least - 1e-9) * np.sqrt(norm[at])
        other = np.flatnonzero(~known)
        other = other[np.argsort(of[other], kind="stable")]
        edges = np.searchsorted(of[other], np.arange(units + 1)) if good.any() else None
        for i, t, d in zip(at[good].tolist(), top[good].tolist(), dot[good].tolist(), strict=True):
            own = other[edges[i] : edges[i + 1]]
            yield i, {
                "whole": whole, "name": names[t], "least": least, "dot": d, "inside": float(inside[i]),
                "others": [{"word": w, "times": n} for w, n in zip(words.hashes[first[own]].view(np.int64).tolist(), times[own].tolist(), strict=True)],
            }

    def runs(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and ends of the runs of words as long as a notice that may reach it; a shorter text is one run.

        Both sums grow word by word: counting each occurrence of a word alone can only raise the cosine.
        """
        terms, edges = _terms(words.hashes, self.vocabulary), words.firsts()
        squares = np.r_[0, np.cumsum(np.append(self.weights**2, 1.0)[terms])]
        start, first, last = np.arange(len(words)), edges[words.owner], edges[words.owner + 1]
        lengths = self.lengths[self.notices]
        for length in np.unique(lengths[lengths > 0]):
            end = np.minimum(start + length, last)
            whole = (end - start == length) | (start == first)
            may = np.zeros(len(words), bool)
            bound = (HEADER_COSINE - 1e-6) * np.sqrt(squares[end] - squares[start])
            for t in np.flatnonzero(lengths == length):
                dots = np.r_[0, np.cumsum(np.append(self.weights * self.matrix[t], 0.0)[terms])]
                may |= dots[end] - dots[start] >= bound
            at = np.flatnonzero(may & whole)
            if len(at):
                yield at, end[at]


_UNITS = pa.list_(pa.struct([
    ("whole", pa.bool_()), ("name", pa.string()), ("least", pa.float64()), ("dot", pa.float64()), ("inside", pa.float64()),
    ("others", pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))),
]))
_UNITS_SQL = "array<struct<whole: boolean, name: string, least: double, dot: double, inside: double, others: array<struct<word: bigint, times: bigint>>>>"


def _found(texts: Texts, matcher: Matcher) -> list[list[dict]]:
    """For each text its candidates, in order."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    words = texts.words(tokens.ALNUM, lower=True)
    starts, ends = texts.spans(_IN_LINE)
    line_of_word = np.searchsorted(starts, words.starts, side="right") - 1
    owner = texts.owner(starts)
    for i, unit in matcher.candidates(words, line_of_word, len(starts), HEADER_COSINE, False, matcher.notices):
        out[owner[i]].append(unit)
    for first, last in matcher.runs(words):
        size = last - first
        run = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(run)) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)
        part = Words(run, words.starts[at], words.ends[at], words.hashes[at], len(size))
        for i, unit in matcher.candidates(part, run, len(size), HEADER_COSINE, False, matcher.notices):
            out[words.owner[first[i]]].append(unit)
    for least, rows in ((FILE_COSINE, matcher.notices), (LICENCE_COSINE, matcher.licences)):
        for i, unit in matcher.candidates(words, words.owner, len(texts), least, True, rows):
            out[i].append(unit)
    return out


#: Words whose counts a task holds before it gives them out.
HELD_WORDS = 1 << 20


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each word is."""
    held, size = [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        word, number = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return word, np.bincount(number, weights=np.concatenate([n for _, n in held]), minlength=len(word)).astype(np.int64)

    def rows() -> pa.RecordBatch:
        word, n = summed()
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for texts in tokens.slices(batch.column(0)):
            words = texts.words(tokens.ALNUM, lower=True)
            _, first = np.unique(tokens.chained([words.hashes, words.owner.astype(np.uint64)]), return_index=True)
            word, n = np.unique(words.hashes[first], return_counts=True)
            held.append((word, n))
            size += len(word)
            if size > HELD_WORDS:
                held = [summed()]
                size = len(held[0][0])
                if 2 * size > HELD_WORDS:
                    yield rows()
                    held, size = [], 0
    if held:
        yield rows()


def _scored(rows: DataFrame, docs: DataFrame, text: str, documents: int) -> DataFrame:
    """The best notice and the best licence of each row that has one, by cosines with all words' weights."""
    units = rows.select("_row", F.posexplode("units").alias("at", "u")).select("_row", "at", "u.*")
    words = units.withColumn("other", F.explode_outer("others")).select(
        "_row", "at", "whole", "name", "least", "dot", "inside", "other.word", "other.times"
    )
    wanted = staged(words.where(F.col("word").isNotNull()).select("word").distinct(), "words-of-candidates")
    counts = docs.select(text).mapInArrow(_word_counts, "word bigint, n bigint")
    counts = staged(counts.groupBy("word").agg(F.sum("n").alias("n")).join(wanted, "word", "left_semi"), "document-counts")
    n = F.least(F.coalesce("n", F.lit(0)), F.lit(documents))
    weight = F.log(F.lit(1.0 + documents) / (1 + n)) + 1
    square = F.when(F.col("word").isNull(), 0.0).otherwise(F.pow(F.col("times") * weight, F.lit(2)))
    norms = (
        words.join(counts, "word", "left").groupBy("_row", "at", "whole", "name", "least", "dot", "inside")
        .agg(F.sum(square).alias("outside"))
        .withColumn("cosine", F.least(F.round(F.col("dot") / F.sqrt(F.col("inside") + F.col("outside")), 12), F.lit(1.0)))
        .where(F.col("cosine") >= F.col("least"))
    )
    order = F.struct(F.col("name") != "Proprietary", "cosine", -F.col("at"))  # "All rights reserved" stands beside other notices
    full = F.col("least") == LICENCE_COSINE
    best = {
        "header": F.max_by(F.struct("name", "cosine"), F.when(~F.col("whole"), order)),
        "like": F.max_by(F.struct("name", "cosine"), F.when(F.col("whole") & ~full, order)),
        "full": F.max_by(F.struct("name", "cosine"), F.when(F.col("whole") & full, order)),
    }
    return norms.groupBy("_row").agg(*(value.alias(kind) for kind, value in best.items()))


def _directory(path: Column) -> Column:
    """The directory of a path, without empty parts; empty for the top."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def licenses(docs: DataFrame, path: Column, matcher: Matcher, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``key``, path, licence, how it is known, cosine and the licence file's path.

    ``how`` is header (a notice in the text), file (the text as a whole is a licence or a notice), inherited, or null
    with a null licence.  A licence as a whole goes before a notice in it.  Only a full licence text under any name, or
    a file with a licence's name (``LICENCE_NAME``) that is like a notice as a whole, hands down to its directory and those
    below, and never "All rights reserved".  Of several such files in a directory the one with the highest cosine counts,
    then the least path.  Null and empty texts
    only inherit; a null path is at the top; repeated rows come back each; an empty table
    gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tokens.slices(batch.column(2)):
                keys = [batch.column(i).slice(texts.first, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(_found(texts, matcher), _UNITS)], names=[key, "path", "units"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, path.alias("_path"), text).mapInArrow(run, f"`{key}` {kind}, path string, units {_UNITS_SQL}")
    rows = staged(rows.withColumn("directory", _directory(F.col("path"))).withColumn("_row", F.monotonically_increasing_id()), "candidates")
    scored = staged(_scored(rows.where(F.size("units") > 0), docs, text, matcher.documents), "licences")
    named = F.col("path").rlike(LICENCE_NAME) & (F.col("like.name") != "Proprietary")
    file = F.coalesce("full", "like")
    rows = rows.drop("units").join(scored, "_row", "left").select(
        key, "path", "directory", F.col("header.name").alias("header"), F.col("header.cosine").alias("header_cosine"),
        file["name"].alias("file"), file["cosine"].alias("file_cosine"),
        (F.col("full").isNotNull() | F.coalesce(named, F.lit(False))).alias("hands_down"),
    )
    rows = staged(rows, "notices")
    best = F.struct(-F.col("file_cosine"), F.col("path"))
    files = (
        rows.where("hands_down").groupBy(F.col("directory").alias("above"))
        .agg(F.min_by("file", best).alias("licence"), F.min_by("path", best).alias("from_path"), F.max("file_cosine").alias("from_cosine"))
    )
    parts = F.when(F.col("directory") == "", F.array().cast("array<string>")).otherwise(F.split("directory", "/"))
    above = rows.select("directory").distinct().withColumn("parts", parts).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("parts"))))
    above = above.select("directory", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("above"))
    nearest = staged(
        above.join(files, "above").groupBy("directory")
        .agg(F.max_by(F.struct("licence", "from_path", "from_cosine"), "depth").alias("near")),
        "nearest-licences",
    )
    own = F.coalesce("file", "header")
    return rows.join(nearest, "directory", "left").select(
        key, "path", F.coalesce(own, "near.licence").alias("licence"),
        F.when(F.col("file").isNotNull(), "file").when(F.col("header").isNotNull(), "header")
        .when(F.col("near").isNotNull(), "inherited").alias("how"),
        F.coalesce("file_cosine", "header_cosine", "near.from_cosine").alias("cosine"),
        F.when(own.isNull(), F.col("near.from_path")).alias("from_path"),
    )
