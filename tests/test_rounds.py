"""Folds that depend on order, done in rounds, against the fold itself."""

import random

import pytest

from tidemark.operators import relational as R
from tidemark.operators import stories
from tidemark.sources import feeds


def packed(handles, longest=470, most=24):
    out, shard, used, n = [], 0, 0, 0
    for h in sorted(handles):
        cost = len(h) + 9
        if n and (used + cost > longest or n >= most):
            shard, used, n = shard + 1, 0, 0
        used, n = used + cost, n + 1
        out.append((h, shard))
    return out


def test_shards_as_by_a_fold(spark):
    rng = random.Random(3)
    modes = {"a": [f"h{k}" + "x" * rng.randint(0, 60) for k in range(2500)], "b": ["one"], "c": [f"{k:04d}" for k in range(48)], "d": ["y" * 500 + str(k) for k in range(3)], "e": [f"z{k:03d}" + "w" * 464 for k in range(4)]}
    rows = [(m, h) for m, hs in modes.items() for h in hs]
    out = sorted(map(tuple, feeds.account_shards(spark.createDataFrame(rows, "mode string, handle string")).collect()))
    assert out == sorted((m, h, s) for m, hs in modes.items() for h, s in packed(hs))
    assert feeds.account_shards(spark.createDataFrame([], "mode string, handle string")).count() == 0


def test_orbit(spark):
    jumps = spark.createDataFrame([(k, k + 3) for k in range(100)] + [(200, None), (300, 300 + 7)], "at long, to long")
    out = sorted(map(tuple, R.orbit(jumps, spark.createDataFrame([(1,), (200,), (300,)], "at long")).collect()))
    assert out == [(k, n) for n, k in enumerate(range(1, 102, 3))] + [(200, 0), (300, 0), (307, 1)]


def kept(pages, same=0.5):
    groups, out = {}, []
    for g, p, runs in sorted(pages, key=lambda r: (r[0], r[1])):
        own = set(runs or [])
        if not any(min(len(k), len(own)) and len(k & own) >= same * min(len(k), len(own)) for k in groups.setdefault(g, [])):
            groups[g].append(own)
            out.append((g, p))
    return out


@pytest.mark.parametrize("first", [2, 256])
def test_first_texts_as_by_a_fold(spark, first):
    rng = random.Random(first)
    pages = []
    for g in range(4):
        seeds = [[f"r{rng.randrange(400)}" for _ in range(rng.randint(1, 30))] for _ in range(12)]
        for p in range(70):
            runs = rng.choice(seeds)
            pages.append((g, p, sorted({r if rng.random() < 0.75 else f"r{rng.randrange(400)}" for r in runs}) if rng.random() > 0.1 else rng.choice([None, []])))
    df = spark.createDataFrame(pages, "group long, place long, runs array<string>")
    out = sorted((r["group"], r["place"]) for r in stories.keep_first_texts(df, "runs", first=first).collect())
    assert out == kept(pages)


def test_a_large_group_of_copies_and_of_others(spark):
    rng = random.Random(9)
    pages = [(1, p, ["a", "b", "c", f"d{p % 3}"]) for p in range(4000)] + [(1, 4000 + p, [f"x{p}", f"y{p}", f"z{rng.randrange(50)}"]) for p in range(4000)]
    df = spark.createDataFrame(pages, "group long, place long, runs array<string>")
    out = sorted(r["place"] for r in stories.keep_first_texts(df, "runs").collect())
    assert out == [0, *range(4000, 8000)]
