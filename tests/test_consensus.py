"""Consensus orders against permutations, subsets and boards computed anew."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.operators import consensus as C
from tidemark.plans import catalogue, domain

SF = "/root/testdata/sf0.001"
Q = catalogue.REGISTRY.queries


def tournament(rng, n, kind):
    if kind == "whole":
        net = rng.integers(-3, 4, (n, n)).astype(float)
    elif kind == "random":
        net = rng.normal(size=(n, n))
    else:
        strength = rng.normal(size=n)
        net = strength[:, None] - strength[None] + rng.normal(size=(n, n))
    net = np.triu(net, 1)
    return net - net.T


def price(w, order):
    return sum(w[a, b] for a, b in itertools.combinations(order, 2))


def by_subsets(w):
    """The least cost of an order, by all sets of first models."""
    n = len(w)
    best = np.full(1 << n, np.inf)
    best[0] = 0
    for done in range(1 << n):
        inside = [i for i in range(n) if done >> i & 1]
        for j in range(n):
            if not done >> j & 1:
                best[done | 1 << j] = min(best[done | 1 << j], best[done] + w[inside, j].sum())
    return best[-1]


@pytest.mark.parametrize("n", range(1, 8))
def test_best_of_all_permutations(n):
    rng = np.random.default_rng(n)
    for kind in ("whole", "whole", "random", "ranked"):
        w = np.maximum(-tournament(rng, n, kind), 0)
        preferred = rng.permutation(n)
        order, proved = C.best_order(w, preferred)
        every = list(itertools.permutations(range(n)))
        least = min(price(w, o) for o in every)
        against = lambda o: sum(preferred[a] > preferred[b] for a, b in itertools.combinations(o, 2))  # noqa: E731, B023
        assert proved and sorted(order) == list(range(n))
        assert price(w, order) == pytest.approx(least)
        assert against(order) == min(against(o) for o in every if price(w, o) <= least + 1e-9)


@pytest.mark.parametrize("n", [9, 12, 14])
@pytest.mark.parametrize("kind", ["whole", "random", "ranked"])
def test_as_cheap_as_by_subsets(n, kind):
    rng = np.random.default_rng(n)
    w = np.maximum(-tournament(rng, n, kind), 0)
    order, proved = C.best_order(w, np.arange(n))
    assert proved and price(w, order) == pytest.approx(by_subsets(w))


@pytest.mark.parametrize(("n", "kind"), [(30, "random"), (40, "ranked"), (40, "units"), (60, "ranked")])
def test_large_boards_are_proved(n, kind):
    rng = np.random.default_rng(n)
    if kind == "units":
        scores = rng.normal(size=(8, n))
        net = np.sign(scores[:, :, None] - scores[:, None, :]).sum(0)
    else:
        net = tournament(rng, n, kind)
    w = np.maximum(-net, 0)
    order, proved = C.best_order(w, np.arange(n))
    assert proved and sorted(order) == list(range(n))
    # The packing of cycles is a second bound on what any order costs.
    y = C.cycle_packing(np.maximum(w.T - w, 0))
    assert (y.sum(2) <= np.maximum(w.T - w, 0) + np.maximum(w - w.T, 0) + 1e-9).all()
    assert np.triu(np.minimum(w, w.T), 1).sum() + y.sum() / 6 <= price(w, order) + 1e-9


def test_a_bound_on_sets_is_said():
    w = np.maximum(-tournament(np.random.default_rng(30), 30, "random"), 0)
    order, proved = C.best_order(w, np.arange(30), sets=3)
    assert not proved and sorted(order) == list(range(30))


def test_gaps_are_the_cheapest_turns():
    rng = np.random.default_rng(7)
    for kind in ("whole", "random"):
        w = np.maximum(-tournament(rng, 6, kind), 0)
        order, _ = C.best_order(w, np.arange(6))
        for k in range(5):
            turned = min(price(w, o) for o in itertools.permutations(range(6)) if o.index(order[k + 1]) < o.index(order[k]))
            assert C.gap(w, order, k)[0] == pytest.approx(turned - price(w, order))


def phi(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def plain_net(scores, factor, ordinal=False, soft=True):
    """Net support of scores (model, unit, weight, score, error) by two loops; factor(unit)."""
    net = defaultdict(float)
    for x, y in itertools.product(scores, repeat=2):
        if x["unit"] == y["unit"] and x["model"] < y["model"]:
            d, e = x["score"] - y["score"], math.hypot(x["error"], y["error"])
            part = 2 * phi(d / e) - 1 if soft and e > 0 and not ordinal else float(np.sign(d))
            net[x["model"], y["model"]] += part * x["weight"] * factor(x["unit"])
    return net


def test_query_orders_are_the_best(spark):
    """Every board of the query: an order as cheap as one found anew, its values from cheapest turns."""
    scores = [r.asDict() for r in domain.board_scores(spark, SF).collect()]
    got = defaultdict(list)
    for r in sorted(Q["c33_consensus_order"](spark, SF).collect(), key=lambda r: r["place"]):
        got[r["board"]].append(r)
    assert set(got) == {s["board"] for s in scores} and len(got) == 7
    for name, rows in got.items():
        own = [s for s in scores if s["board"] == name]
        net = plain_net(own, lambda u: 1.0)
        models = [r["model"] for r in rows]
        assert sorted(models) == sorted({s["model"] for s in own}) and [r["place"] for r in rows] == list(range(1, len(rows) + 1))
        w = np.array([[max(0.0, -(net[a, b] if a < b else -net[b, a])) if a != b else 0.0 for b in models] for a in models])
        assert all(r["optimal"] for r in rows)
        places = list(range(len(models)))
        assert C.total_cost(w, places) == pytest.approx(C.total_cost(w, C.least_order(w)[0]))
        for r, s in zip(rows, rows[1:]):
            assert -1e-9 <= r["value"] - s["value"] <= w[s["place"] - 1, r["place"] - 1] + 1e-9


def test_stability_as_computed_anew(spark):
    """Ranges of ranks from boards recomputed one by one, in the order that all permutations give."""
    rng = np.random.default_rng(11)
    models, units = "abcde", range(4)
    scores = [{"board": b, "model": m, "unit": u, "operator": u % 2, "weight": 1.0 + u % 2, "score": float(rng.integers(0, 9)), "error": float(rng.integers(0, 3))} for b in (1, 2) for m in models for u in units if rng.random() < 0.8]
    df = spark.createDataFrame(scores)
    parts, design = C.unit_support(df, ["board"]), C.variants(df, ["board"])
    order = C.consensus(parts.groupBy("board", "a", "b").agg(C.F.sum("part").alias("net")), "board", [])
    places = spark.createDataFrame(order.select("board", "model", "place").toPandas())
    least = 2
    out = {(r["board"], r["model"]): r for r in C.stability(C.variant_support(parts, design, ["board"]), C.still_qualified(df, design, ["board"], least), places, ["board"]).collect()}
    at = {(r["board"], r["model"]): r["place"] for r in places.collect()}

    def ranks(own, prefer, factor, ordinal=False):
        net = plain_net(own, factor, ordinal)
        names = [m for m in models if m in prefer]
        cost = lambda o: sum(max(0.0, -(net.get((x, y), 0.0) if x < y else -net.get((y, x), 0.0))) for x, y in itertools.combinations(o, 2))
        against = lambda o: sum(prefer[x] > prefer[y] for x, y in itertools.combinations(o, 2))
        every = list(itertools.permutations(names))
        low = min(map(cost, every))
        best = min((o for o in every if cost(o) <= low + 1e-9), key=against)
        return {m: k for k, m in enumerate(best, 1)}

    for b in (1, 2):
        own = [s for s in scores if s["board"] == b]
        prefer = {m: p for (x, m), p in at.items() if x == b}
        # Each design: the units it drops, the factor of each unit, whether signs count.
        trials = [(lambda u, o=o: u % 2 == o, lambda u, o=o: 0.0 if u % 2 == o else 1.0, False) for o in {s["operator"] for s in own}]
        trials += [(lambda u, k=k: u == k, lambda u, k=k: 0.0 if u == k else 1.0, False) for k in {s["unit"] for s in own}]
        trials += [(lambda u: False, lambda u, k=k, f=f: f if u == k else 1.0, False) for k in {s["unit"] for s in own} for f in (0.8, 1.2)]
        trials += [(lambda u: False, lambda u: 1.0, True)]
        fixed, again, missing = defaultdict(list), defaultdict(list), defaultdict(int)
        for dropped, factor, ordinal in trials:
            for m, r in ranks(own, prefer, factor, ordinal).items():
                fixed[m].append(r)
            kept = {m for m in prefer if sum(s["model"] == m and not dropped(s["unit"]) for s in own) >= least}
            for m, r in ranks([s for s in own if s["model"] in kept], {m: p for m, p in prefer.items() if m in kept}, factor, ordinal).items():
                again[m].append(r)
            for m in set(prefer) - kept:
                missing[m] += 1
        for m, p in prefer.items():
            r = out[b, m]
            assert (r["fixed_from"], r["fixed_to"]) == (min([p, *fixed[m]]), max([p, *fixed[m]]))
            assert (r["rank_from"], r["rank_to"]) == (min([p, *again[m]]), max([p, *again[m]]))
            assert (r["scenarios"], r["unavailable"], r["incomplete"]) == (len(trials), missing[m], 0)
