"""Pruned nearest neighbours against all pairs."""

import numpy as np
import pytest

from tidemark.operators import neighbours as N


def plain(rows, queries):
    out = {}
    for q, qv in queries:
        a = np.asarray(qv) / np.linalg.norm(qv)
        scored = sorted((-round(float(a @ (np.asarray(v) / np.linalg.norm(v))), 9), i) for i, v in rows if v and any(v) and i != q)
        if scored:
            out[q] = scored[0][1]
    return out


def clustered(n, d, groups, spread, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [(k, [float(x) for x in centres[k % groups] + spread * rng.normal(size=d)]) for k in range(n)]


@pytest.mark.parametrize(("d", "spread", "block"), [(2, 0.5, 4096), (8, 0.1, 7), (32, 1.0, 4096)])
def test_as_by_all_pairs(spark, d, spread, block):
    rows = clustered(500, d, 12, spread)
    rows += [(1000 + k, rows[k][1]) for k in range(30)] + [(2000, None), (2001, [0.0] * d), (2002, [])]
    queries = [(i, v) for i, v in rows if i % 9 == 0 and v and any(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found, work = N.nearest(spark.createDataFrame(queries, "query long, v array<double>"), df, 16, block)
    assert {r["query"]: r["nearest"] for r in found.collect()} == plain(rows, queries)
    scored, total = work.first()
    assert total == len(queries) * 530 and 0 < scored < total


def test_close_groups_need_few_pairs(spark):
    rows = clustered(3000, 16, 40, 0.02)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = spark.createDataFrame(rows[::50], "query long, v array<double>")
    found, work = N.nearest(queries, df)
    assert {r["query"]: r["nearest"] for r in found.collect()} == plain(rows, rows[::50])
    scored, total = work.first()
    assert scored < 0.15 * total


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    found, work = N.nearest(none.withColumnRenamed("id", "query"), none)
    assert found.count() == 0 and tuple(work.first()) == (0, 0)
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert N.nearest(one.withColumnRenamed("id", "query"), one)[0].count() == 0
