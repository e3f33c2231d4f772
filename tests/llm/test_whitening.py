"""Whitening against exact fractions and a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening as W


def exact_scatter(xs):
    n, d = len(xs), len(xs[0])
    s = [sum(x[k] for x in xs) for k in range(d)]
    y = [[n * x[k] - s[k] for k in range(d)] for x in xs]
    return [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)], s


def vectors(n=80, d=6, scale=1.0):
    rng = np.random.default_rng(5)
    return [[float(v) for v in row] for row in rng.normal(size=(n, d)) @ np.diag([5, 3, 2, 1, 0.5, 0.1][:d]) * scale + 7]


ODD = [(None, [1.0] * 6), (900, None), (901, [1.0, None, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [1e300] * 6)]


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_as_by_fractions(spark, scale):
    rows = list(enumerate(vectors(scale=scale)))
    rows += [(500 + k, rows[3][1]) for k in range(40)] + [(7, rows[7][1])]
    docs = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n")
    out = W.whiten(docs).collect()
    kept = rows + ODD[:1]
    grid = [tuple(math.floor(256 * c) for c in v) for _, v in kept]
    fit = sorted(set(grid))
    m, s = exact_scatter(fit)
    n = len(fit)
    cov = np.array([[float(Fraction(v, n**3)) for v in r] for r in m])
    values, vecs = np.linalg.eigh(cov)
    assert len(out) == 4 * len(kept)
    assert {r["n"] for r in out} == {n}
    want = {}
    for (k, _), x in zip(kept, grid):
        want.setdefault(k, (sum((n * a - b) ** 2 for a, b in zip(x, s)), np.array([a - b / n for a, b in zip(x, s)]) @ vecs[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])))
    signs = {}
    for r in out:
        deviation, white = want[r["vec_id"]]
        assert r["deviation"] == (deviation if deviation < 2**63 else None)
        value = white[r["component"] - 1]
        assert abs(abs(r["whitened"]) - abs(value)) < 1e-7
        if abs(value) > 1e-3:
            signs.setdefault(r["component"], set()).add(np.sign(r["whitened"] * value))
        assert r["explained"] == pytest.approx(values[::-1][r["component"] - 1] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert all(len(v) == 1 for v in signs.values())


def test_scatter_is_exact(spark):
    xs = [(k * 10**9 + 3, -k * k, 7 * k % 11) for k in range(1, 60)]
    rows = spark.createDataFrame([(list(x),) for x in xs], "x array<long>").repartition(5)
    n, s, most = W.gathered(rows)
    want, sums = exact_scatter(xs)
    assert (n, s, most) == (len(xs), sums, 59 * 10**9 + 3)
    assert W.scatter(rows, n, s, most) == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0])] * 9, [(1, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, rows):
    out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.count() == 0 and len(out.columns) == 7


def test_rank_below_four(spark):
    rows = [(f"k{k}", [float(k), 2.0 * k, 1.0]) for k in range(9)]
    out = W.whiten(spark.createDataFrame(rows, "name string, v array<float>"), "name", "v").collect()
    assert sorted(r["vec_id"] for r in out) == sorted(f"k{k}" for k in range(9))
    assert {(r["component"], round(r["explained"], 9)) for r in out} == {(1, 1.0)}
