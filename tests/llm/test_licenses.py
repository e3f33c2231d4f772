import math
import random
import textwrap
from collections import Counter
from pathlib import Path

import pytest

from tidemark.llm import licenses

SCHEMA = "doc_id long, path string, text string"


def brute_best(text, n, counts, threshold):
    weight = lambda t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1
    vec = lambda x: {t: k * weight(t) for t, k in Counter(licenses.terms(x)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1
    a = vec(text)
    best = max((round(sum(v * b.get(t, 0) for t, v in a.items()) / norm(a) / norm(b), 9), name) for name, texts in licenses.NOTICES.items() for x in texts for b in [vec(x)])
    return best if best[0] >= threshold else (0.0, None)


FILES = [
    (1, "a/LICENSE", "MIT License\n\n" + licenses.NOTICES["MIT"][3]),
    (2, "a/x.py", "# code\nvalue = 1"),
    (3, "a/b/y.py", None),
    (4, "a/b/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    (5, "a/b/c/d/z.py", "# SPDX-License-Identifier: Apache-2.0\nprint()"),
    (6, "a/b/c/d/q.py", ""),
    (7, "ab/x.py", "the use of this text is free to all"),
    (8, None, "words " * 50_000),
    (9, "c/LICENSE.txt", "nothing that says what one may do here"),
    (10, "c/x", "x"),
    (None, "a/n.py", "none"),
    (2, "a/x.py", "# code\nvalue = 1"),
    (11, "a/blicense/x", "q"),
]


def test_inheritance(spark):
    frame = spark.createDataFrame(FILES, SCHEMA).selectExpr("*", "1 as dir", "2 as above", "3 as n")
    got = {(r["doc_id"], r["path"]): (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(frame).collect()}
    assert got == {
        (1, "a/LICENSE"): ("MIT", "MIT", None),
        (2, "a/x.py"): (None, "MIT", "a"),
        (3, "a/b/y.py"): (None, "GPL-3.0", "a/b"),
        (4, "a/b/COPYING"): ("GPL-3.0", "GPL-3.0", None),
        (5, "a/b/c/d/z.py"): ("Apache-2.0", "Apache-2.0", None),
        (6, "a/b/c/d/q.py"): (None, "GPL-3.0", "a/b"),
        (7, "ab/x.py"): (None, None, None),
        (8, ""): (None, None, None),
        (9, "c/LICENSE.txt"): (None, None, None),
        (10, "c/x"): (None, None, None),
        (None, "a/n.py"): (None, "MIT", "a"),
        (11, "a/blicense/x"): (None, "MIT", "a"),
    }
    assert licenses.scan(frame).count() == len(FILES)


def test_cosine_against_all_templates():
    counts = {"the": 60, "of": 50, "under": 20, "license": 5}
    matcher = licenses.Matcher(100, counts, 0.6)
    lines = [x for texts in licenses.NOTICES.values() for x in texts] + ["the of under", "Licensed under the license", "the license of the version", "see CC BY", "", "free of charge to any person the and of this"]
    for x in lines:
        score, name = brute_best(x, 100, counts, 0.6) if licenses.terms(x) else (0.0, None)
        got = matcher.best(licenses.terms(x))
        assert (round(got[1], 6), got[0]) == (round(score, 6), name)


def test_counts_cover_all_rows(spark):
    n, counts = licenses.document_counts(spark.createDataFrame(FILES, SCHEMA), {"the", "license", "mit"})
    assert n == len(FILES)
    assert counts["the"] == sum("the" in licenses.terms(t or "") for _, _, t in FILES)


COMMON = {"the": 60_000, "of": 50_000, "and": 60_000, "to": 60_000, "a": 50_000, "in": 50_000, "or": 40_000, "this": 30_000, "you": 20_000, "that": 30_000, "for": 40_000}


def test_whole_texts_are_told_apart(spark):
    """Each licence text under another name, rewrapped, with a line before and one in ten words gone."""
    whole = licenses.whole_texts(licenses.TEXTS)
    assert {"GPL-1.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "GFDL-1.2", "GFDL-1.3", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "CC0-1.0"} <= set(whole)
    rng = random.Random(3)
    rows = []
    for k, (name, (text,)) in enumerate(whole.items()):
        rows.append((k, f"p{k}/COPYING", "Copyright 2020 by one of us\n" + textwrap.fill(" ".join(w for w in text.split() if rng.random() > 0.1), 60)))
        rows.append((100 + k, f"p{k}/lib/part.c", "int x;"))
    rows.append((999, "other/LICENSE", " ".join(rng.choice(list(COMMON)) for _ in range(4000))))
    got = {r["doc_id"]: (r["own_license"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {999: (None, None), **{k: (name, name) for k, name in enumerate(whole)}, **{100 + k: (None, name) for k, name in enumerate(whole)}}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-2").exists(), reason="no system licence texts")
@pytest.mark.parametrize(("file", "name"), [("GPL-1", "GPL-1.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2", "LGPL-2.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"), ("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3"), ("Artistic", "Artistic-1.0-Perl")])
def test_system_files(file, name):
    matcher = licenses.Matcher(100_000, COMMON, licenses.WHOLE, licenses.whole_texts(licenses.TEXTS))
    assert matcher.best(licenses.terms((Path("/usr/share/common-licenses") / file).read_text()))[0] == name


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


WRAPPED = [("MIT", 3), ("BSD-3-Clause", 2), ("GPL-3.0", 1), ("GPL-2.0", 1), ("ISC", 2)]


@pytest.mark.parametrize("width", [12, 40, 72])
def test_wrapped_headers(spark, width):
    """Notices in comments over several lines, between other lines, in files that are no licence files."""
    rows = [(100, "LICENSE", "Released under the ISC License.")]
    for k, (name, nth) in enumerate(WRAPPED):
        lines = textwrap.wrap(licenses.NOTICES[name][nth], width)
        rows.append((k, f"src/{k}.py", "\n".join(["#!/usr/bin/env python", "# tool, made in 2020", "#", *[f"# {x}" for x in lines], "#", "import os", "value = os.getcwd()"])))
    got = {r["doc_id"]: (r["own_license"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {100: ("ISC", None), **{k: (name, None) for k, (name, _) in enumerate(WRAPPED)}}


def test_best_run_against_all_runs():
    rng = random.Random(6)
    counts = {"the": 60, "of": 50, "under": 20, "license": 5}
    matcher = licenses.Matcher(100, counts, 0.6)
    texts = [x for texts in licenses.NOTICES.values() for x in texts]
    for _ in range(60):
        lines = [rng.choice(["x = 1", "the end of it", "#", "", "copy of the software"]) for _ in range(rng.randrange(6))]
        at = rng.randrange(len(lines) + 1)
        lines[at:at] = textwrap.wrap(rng.choice(texts), rng.choice([10, 30, 60]))
        split = [x for x in map(licenses.terms, lines) if x]
        runs = [split[i:j] for i in range(len(split)) for j in range(i + 1, len(split) + 1) if sum(map(len, split[i + 1 : j - 1])) <= licenses.LONGEST]
        want = max(brute_best(" ".join(t for x in r for t in x), 100, counts, 0.6)[0] for r in runs)
        assert round(matcher.best_run([licenses.terms(x) for x in lines])[1], 6) == round(want, 6)
