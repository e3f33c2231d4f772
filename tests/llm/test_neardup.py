import random
import re

import numpy as np
import pytest

from tidemark.llm import neardup
from tidemark.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    docs = [(d, grams(t)) for d, t in rows]
    root = {d: d for d, _ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(docs):
        for b, y in docs[:i]:
            if a is None or b is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(g), find(d) if d is not None else None, d is None or find(d) == d) for d, g in docs), key=str)


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, groups=25, big=0):
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = []
    passage = fresh(60)
    for _ in range(groups):
        base = fresh(rng.choice([4, 12, 80, 300]))
        texts += [base] + [edited(rng, base, rng.choice([0, 1, 1, 2, 3])) for _ in range(rng.choice([0, 1, 4]))]
    texts += [f"{passage} {fresh(40)}" for _ in range(60)]
    if big:
        base = fresh(400)
        texts += [edited(rng, base, rng.choice([1, 3, 5, 6, 7])) for _ in range(big)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One Two"), (9004, "one two"), (9005, "two one"), (None, texts[0]), (3, texts[3])]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as root", "2 as vertex", "3 as path")
    return sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("small", "hot", "block"), [(6, 10**6, 300), (6, 20, 15)])
def test_large_groups(spark, monkeypatch, small, hot, block):
    """Bounds so low that nodes branch, meet pivots, are dealt in blocks, and components too."""
    for name, value in (("SMALL", small), ("HOT", hot), ("BLOCK", block)):
        monkeypatch.setattr(neardup, name, value)
    rows = corpus(2, groups=8, big=120)
    got, want = run(spark, rows), brute(rows)
    assert got == want
    assert max(sum(r[2] == c for r in want) for c in {r[2] for r in want}) > 60


def test_node_links_connect_what_is_alike(monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (3, neardup.COORDINATES), dtype=np.uint8)
    sketches = np.concatenate([np.where(rng.random((30, neardup.COORDINATES)) < 0.12, rng.integers(0, 256, (30, neardup.COORDINATES)), b).astype(np.uint8) for b in base])
    paths = np.ones((90, neardup.LEVELS), np.int64)
    groups = neardup.Groups(90)
    for i, j in neardup.node_links(paths, sketches, 1, np.arange(90)):
        groups.join(i, j)
    roots = [groups.find(i) for i in range(90)]
    for i in range(90):
        for j in np.flatnonzero(neardup.alike(sketches, i) >= neardup.AGREE):
            assert roots[i] == roots[j]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 300)] + [(7, 8), (8, 9)]
    found = neardup.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    got = {r["vertex"]: r["root"] for r in found.collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 5 for k in [5, *range(200, 300)]}, 7: 7, 8: 7, 9: 7}


def test_runs_over_batches():
    import pandas as pd

    frame = pd.DataFrame({"k": [1, 1, 1, 2, 3, 3, 4], "v": range(7)})
    for cuts in ([3], [1, 2, 4], [0, 5], [6], list(range(7))):
        parts = np.split(np.arange(7), cuts)
        got = [(int(g["k"].iloc[0]), g["v"].tolist()) for g in neardup.runs((frame.iloc[p] for p in parts), ["k"])]
        assert got == [(1, [0, 1, 2]), (2, [3]), (3, [4, 5]), (4, [6])]


def test_shingle_sets():
    for text in ("", "A b", "a b c d e", "a b c d e f", "É é a b c d e", "x " * 50):
        assert len(neardup.shingle_set(text)) == len(grams(text))
    assert (neardup.shingle_set("A B c D e f") == neardup.shingle_set("a b\nc d  e F")).all()


def test_an_id_with_several_texts(spark):
    """Id 1 comes with two texts, of which 2 and 3 have a copy each, 4 a near copy of the second."""
    rng = random.Random(8)
    a, b = (" ".join(f"t{rng.randrange(10**6)}" for _ in range(90)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, f"{b} more"), (5, "not like these at all")]
    assert run(spark, rows) == brute(rows)


def test_ids_that_are_strings(spark):
    rows = [(f"k{d}" if d is not None else None, t) for d, t in corpus(6, groups=6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_a_large_candidate_component_that_does_not_hold(spark, monkeypatch):
    """Texts of one form, mostly just under the threshold: sketches link nearly all of them, full
    sets only some, and those not along the first links. Every one of these is found."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = random.Random(9)
    form = [f"form{k}" for k in range(200)]
    texts = []
    for _ in range(150):
        w = list(form)
        for at in rng.sample(range(0, 200, 10), rng.choice([1, 2, 3])):
            w[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = brute(rows, 88)
    assert 10 < sum(r[3] for r in want) < 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs, 88).collect()), key=str)
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)


def test_empty_and_long(spark):
    assert run(spark, []) == []
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2])]
    assert [r[2] for r in run(spark, rows)] == [1, 1, 3]


def test_keep_one(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] for r in neardup.keep_one(docs).collect()), key=str)
    assert kept == sorted((r[0] for r in brute(rows) if r[3]), key=str)


def between(seed, low, high, n):
    """n pairs of texts whose shingle sets have a similarity from low to below high, in percent."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(rng.choice([60, 120, 300])))
        other = edited(rng, base, rng.randrange(1, 9))
        x, y = grams(base), grams(other)
        if low <= 100 * len(x & y) / len(x | y) < high:
            out.append((base, other))
    return out


@pytest.mark.parametrize("small", [48, 2])
def test_pairs_between_80_and_85(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = list(enumerate(t for seed, low, high in ((1, 80, 85), (2, 75, 80), (3, 85, 95)) for pair in between(seed, low, high, 40) for t in pair))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 80)
    assert sum(not r[3] for r in want) == 80
    assert sorted(map(tuple, neardup.near_duplicates(docs, 80).collect()), key=str) == want
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == sorted(r[0] for r in want if r[3])


def test_bounds_follow_the_threshold():
    assert [(round(64 * neardup.agreement(p)), neardup.trees_for(p)) for p in (70, 80, 85)] == [(31, 22), (38, 12), (43, 8)]
    rng = np.random.default_rng(4)
    for p in (70, 80, 85):
        hit = rng.random((20_000, neardup.COORDINATES)) < p / 100
        assert (hit.mean(1) < neardup.agreement(p)).mean() < 5e-4


def test_small_groups_that_share_a_frequent_passage(spark, monkeypatch):
    """Nodes of the passage are over HOT, and no two groups are alike beyond it: none is lost."""
    monkeypatch.setattr(neardup, "HOT", 20)
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    passage, texts = fresh(195), []
    for _ in range(300):
        base = f"{passage} {fresh(55)}"
        texts += [base, f"{base} {fresh(1)}"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows, 95)
    assert sum(r[3] for r in want) == 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(docs, 95).collect()), key=str) == want


def test_leaf_links_connect_what_is_alike(spark, monkeypatch):
    """One leaf in many blocks, with groups that are unlike its pivot."""
    monkeypatch.setattr(neardup, "HOT", 7)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (20, neardup.COORDINATES), dtype=np.uint8)
    sketches = np.concatenate([np.where(rng.random((4, neardup.COORDINATES)) < 0.12, rng.integers(0, 256, (4, neardup.COORDINATES)), b).astype(np.uint8) for b in base])
    rows = [(i, bytearray(x.tobytes()), 5) for i, x in enumerate(sketches)]
    found = neardup.leaf_links(spark.createDataFrame(rows, "vertex long, sketch binary, leaf long"), Scratch(spark)).collect()
    groups = neardup.Groups(len(rows))
    for a, b in found:
        groups.join(a, b)
        assert neardup.alike(sketches, a)[b] >= neardup.AGREE
    assert all(groups.find(i) == groups.find(j) for i in range(len(rows)) for j in np.flatnonzero(neardup.alike(sketches, i) >= neardup.AGREE))
