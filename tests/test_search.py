"""Substring search by posting lists against a scan."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.operators import search as S


@pytest.fixture(scope="module")
def bodies(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "ünder", "中文", "a", "xyz-1", "Delta", "😀", "of"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) + (f" rare{k}" if k % 97 == 0 else "")) for k in range(400)] + [(900, None), (901, ""), (902, "ab"), (903, "x" * 100_000)]
    df = spark.createDataFrame(rows, "id long, body string")
    return rows, df, S.build(df, f"file://{tmp_path_factory.mktemp('index')}/lists")


@pytest.mark.parametrize("term", ["alpha", "ALPHA b", "rare97", "pha ga", "z", "of", "中", "文 中", "😀", "ün", "ab", "nowhere", "xxxx", "-1 d", "a a a"])
def test_as_by_a_scan(bodies, term):
    rows, df, index = bodies
    want = sorted(k for k, t in rows if t is not None and term.lower() in t.lower())
    assert sorted(r["id"] for r in S.containing(index, df, term).collect()) == want


def test_few_rows_are_read(bodies):
    _, df, index = bodies
    assert S.share_read(index, df, "rare97") < 0.02 and S.share_read(index, df, "nowhere") == 0
    plan = index._of("lists", ["rar"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_no_terms_and_no_bodies(spark, bodies, tmp_path):
    _, df, index = bodies
    assert S.public_match(df, S.F.col("body"), index, df, []).count() == df.count()
    empty = df.limit(0)
    none = S.build(empty, f"file://{tmp_path}/lists")
    assert [r["id"] for r in S.public_match(df, S.F.lower("body"), none, empty, ["rare97"]).collect()] == [97]


def test_lists_hold_each_gram_and_text_once(bodies, monkeypatch):
    rows, _, index = bodies
    want = {(t.lower()[i : i + k], n) for n, t in rows if t for k in (1, 2, 3) for i in range(len(t) - k + 1)}
    lists = index._table("lists").collect()
    got = [(r["gram"], i) for r in lists for i in r["ids"]]
    assert len(got) == len(set(got)) and set(got) == want
    # A task's texts share a row a gram, so that rows are far fewer than what they hold.
    assert 3 * len(lists) < len(got)
    assert {r["gram"]: r["n"] for r in index._table("sizes").collect()} == Counter(g for g, _ in want)
    # Alphabets too large for a table, and texts a few at a time, give the same.
    batch = pa.RecordBatch.from_pydict({"id": pa.array([n for n, _ in rows]), "body": pa.array([(t or "").lower() for _, t in rows])})
    for name, value in (("CODES", 4), ("CHARS", 50)):
        monkeypatch.setattr(S, name, value)
        made = [(g, i) for b in S._lists(iter([batch])) for g, ids in zip(b["gram"].to_pylist(), b["ids"].to_pylist(), strict=True) for i in ids]
        assert len(made) == len(want) and set(made) == want
