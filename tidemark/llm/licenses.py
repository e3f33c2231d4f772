"""License scans: TF-IDF cosine to templates, then the nearest ancestor directory's licence.

A file's whole text is compared with whole licence texts, which tell versions apart by all their
terms. Where it is none of these, every line of it and every run of lines that may hold a wrapped
notice are compared with short notices. Terms are weighed by how many documents of the whole corpus
have them. Directories then inherit from their nearest ancestor with a licence file, by joins on
paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib.resources import files as resources
from importlib.resources.abc import Traversable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, met

# Short forms in which these licences are declared, and what their texts grant.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC0-1.0": ["Released under CC0 1.0 Universal, dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential."],
}
#: Names of files whose licence holds for their directory and those below.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
TERM = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
#: The least cosine to a notice, and to a whole licence text.
THRESHOLD, WHOLE = 0.6, 0.9
#: A folder of licence texts, each named by its licence.
TEXTS = resources("tidemark.llm") / "license_texts"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


#: Terms of the longest template. A copy of a template, wrapped at whatever width, has its inner
#: lines to itself, so a run has no more terms than this beside those of its first and last line.
LONGEST = max(len(TERM.findall(x.lower())) for texts in NOTICES.values() for x in texts)


def whole_texts(folder: Traversable) -> dict[str, list[str]]:
    return {p.name.removesuffix(".txt"): [p.read_text()] for p in sorted(folder.iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}


def document_counts(files: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """How many rows there are, and how many have each term of the vocabulary, over whole texts."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM.pattern), F.lit(0)))
    # The vocabulary is that of the templates, whatever the corpus.
    wanted = files.sparkSession.createDataFrame([(t,) for t in sorted(vocabulary)], "term string")
    rows = files.select(F.explode(found).alias("term")).join(F.broadcast(wanted), "term").groupBy("term").count().collect()
    return files.count(), {r["term"]: r["count"] for r in rows}


class Matcher:
    """Cosine of a token list to every template, with the corpus weights."""

    def __init__(self, n: int, counts: dict[str, int], threshold: float, templates: dict[str, list[str]] | None = None):
        self.n, self.counts = n, counts
        self.threshold = threshold
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.names, self.rare = [], set()
        for name, texts in (NOTICES if templates is None else templates).items():
            for x in texts:
                vector = {t: k * self.weight(t) for t, k in Counter(terms(x)).items()}
                norm = math.sqrt(sum(v * v for v in vector.values()))
                for t, v in vector.items():
                    self.postings[t].append((len(self.names), v / norm))
                # A line without a term beyond these can't reach the threshold: by the inequality
                # of Cauchy and Schwarz its cosine is at most the root of their share.
                share = 0.0
                for t, v in sorted(vector.items(), key=lambda p: (p[1], p[0])):
                    share += (v / norm) ** 2
                    if share >= threshold**2:
                        self.rare.add(t)
                self.names.append(name)

    def weight(self, term: str) -> float:
        return math.log((1 + self.n) / (1 + self.counts.get(term, 0))) + 1

    def best(self, found: list[str]) -> tuple[str | None, float]:
        if self.rare.isdisjoint(found):
            return None, 0.0
        vector = {t: k * self.weight(t) for t, k in Counter(found).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        dots: dict[int, float] = defaultdict(float)
        for t, v in vector.items():
            for k, w in self.postings.get(t, ()):
                dots[k] += v * w
        k, score = max(dots.items(), key=lambda p: (p[1], self.names[p[0]]))
        score = min(1.0, score / norm)
        return (self.names[k], score) if score >= self.threshold else (None, 0.0)

    def best_run(self, lines: list[list[str]]) -> tuple[str | None, float]:
        """The best of all lines and of all runs of lines with at most LONGEST terms between the
        first and the last one. Lines without a term, as bare comment marks, part no run."""
        lines = [x for x in lines if x]
        n = len(lines)
        # From each line, the next one with a term that a run can't do without.
        rare_at = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            rare_at[i] = rare_at[i + 1] if self.rare.isdisjoint(lines[i]) else i
        best, best_name = 0.0, ""
        for i in range(n):
            if rare_at[i] == n:
                break
            # Without such a first line the rest of the run scores more.
            if self.postings.keys().isdisjoint(lines[i]):
                continue
            vector: dict[str, float] = defaultdict(float)
            dots: dict[int, float] = defaultdict(float)
            square, inner = 0.0, 0
            for j in range(i, n):
                if inner > LONGEST:
                    break
                for t, k in Counter(lines[j]).items():
                    v, had = k * self.weight(t), vector[t]
                    vector[t] = had + v
                    square += v * (v + 2 * had)
                    for at, w in self.postings.get(t, ()):
                        dots[at] += v * w
                if j > i:
                    inner += len(lines[j])
                if rare_at[i] <= j and dots:
                    k, dot = max(dots.items(), key=lambda p: (p[1], self.names[p[0]]))
                    score = min(1.0, dot / math.sqrt(square))
                    if (score, self.names[k]) > (best, best_name):
                        best, best_name = score, self.names[k]
        return (best_name, best) if best >= self.threshold else (None, 0.0)


def declared(files: DataFrame, threshold: float = THRESHOLD, texts: Traversable = TEXTS) -> DataFrame:
    """doc_id, path, own_license, own_score: the licence that a file's whole text is, or else the
    one that its best line or run of lines declares; null and 0 if none reaches its threshold."""
    whole = whole_texts(texts)
    n, counts = document_counts(files, {t for of in (NOTICES, whole) for xs in of.values() for x in xs for t in terms(x)})
    shipped = files.sparkSession.sparkContext.broadcast((Matcher(n, counts, threshold), Matcher(n, counts, WHOLE, whole)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notices, licences = shipped.value
        for b in batches:
            out = []
            for doc, path, text in zip(b["doc_id"], b["path"], b["text"], strict=True):
                lines = [terms(x) for x in text.split("\n")]
                found = licences.best([t for x in lines for t in x])
                if found[0] is None:
                    found = notices.best_run(lines)
                out.append((doc, path, *found))
            yield pd.DataFrame(out, columns=["doc_id", "path", "own_license", "own_score"])

    slim = files.select(F.col("doc_id").cast("string"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    found = slim.mapInPandas(run, "doc_id string, path string, own_license string, own_score double")
    return found.withColumn("doc_id", F.col("doc_id").cast(files.schema["doc_id"].dataType))


def directory(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, own_score, license, inherited_from for each row of files.

    files: doc_id, path (parts by /; null is a file at the root), text. license is the file's own,
    else that of the nearest directory at or above it with a licence file that declares one
    (the best score, then the first name, where it has several), in inherited_from; else null.
    A null text declares nothing. Directories, not files, meet their ancestors, so a directory
    with very many files is one row there; files then meet their directory in shares.
    """
    scratch = Scratch(files.sparkSession)
    own = scratch.save(declared(files, threshold)).withColumn("dir", directory(F.col("path")))
    named = own.where(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    holders = named.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("l")))["l"].alias("dir_license"))
    dirs = own.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = dirs.withColumn("above", F.explode(F.array_distinct(above)))
    # Every directory has the root above it, so that key is dealt in shares.
    nearest = met(ancestors, scratch.save(holders.withColumnRenamed("dir", "above")), ["above"], F.col("dir")).groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "dir_license")).alias("near"))
    shares = nearest.select(F.col("dir").alias("d"), "near.above", "near.dir_license", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("share"))
    out = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(shares, (F.col("dir") == F.col("d")) & (F.col("salt") == F.col("share")), "left")
    inherits = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(inherits, F.col("above")).alias("inherited_from"))
