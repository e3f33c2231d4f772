"""One order from many partial rankings: representatives, qualification, net support, Kemeny order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.math import soft_support
from tidemark.session import checkpointed, few

#: Sets of models that the search for an order holds at a time; beyond it nothing is proved.
SETS = 300_000
#: Sets that are extended at a time.
STEP = 20_000


def representatives(rows: DataFrame, keys: list[str], order: list[Column], ineligible: Column) -> DataFrame:
    """Each key's first eligible row in order, and why the others were not taken in `reason`."""
    nth = F.row_number().over(Window.partitionBy(*keys, ineligible).orderBy(*order))
    ranked = rows.withColumn("_bad", ineligible).withColumn("_nth", nth)
    reason = F.when(F.col("_bad"), "ineligible").when(F.col("_nth") == 1, "representative").otherwise("other configuration")
    return ranked.withColumn("reason", reason).drop("_bad", "_nth")


def unit_support(scores: DataFrame, by: list[str] | None = None, soft: bool = True, direction: str | None = None) -> DataFrame:
    """by, unit, a, b, weight, part, sign: what each unit adds for each pair of its models (a < b).

    scores: model, unit, weight, score, the columns of `by` (boards, say), and for soft support
    `error`. sign is the unit's weight times the sign of the difference; part the same for ordinal
    support, else weight (2 Phi(difference / error) - 1). direction: a column that is LOWER where
    less is better. The self join is by unit: the panel of models a unit has is small.
    """
    by = by or []
    columns = ["model", "score", *(["error"] if soft else []), *([direction] if direction else [])]
    a = scores.select(*by, "unit", "weight", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = scores.select(*by, "unit", *[F.col(c).alias(f"b_{c}") for c in columns])
    delta = F.col("a_score") - F.col("b_score")
    if direction:
        delta = F.when(F.col(f"a_{direction}") == "LOWER", -delta).otherwise(delta)
    sign = F.signum(delta)
    support = soft_support(delta, F.sqrt(F.col("a_error") ** 2 + F.col("b_error") ** 2)) if soft else sign
    pairs = a.join(b, [*by, "unit"]).where("a_model < b_model")
    return pairs.select(*by, "unit", F.col("a_model").alias("a"), F.col("b_model").alias("b"), "weight", (support * F.col("weight")).alias("part"), (sign * F.col("weight")).alias("sign"))


def net_support(scores: DataFrame, soft: bool = True, direction: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by, a, b, net, weight, shared for each pair of models (a < b) that share a unit: the sums of
    `unit_support` over units."""
    parts = unit_support(scores, by, soft, direction)
    return parts.groupBy(*(by or []), "a", "b").agg(F.sum("part").alias("net"), F.sum("weight").alias("weight"), F.count("*").alias("shared"))


def variants(units: DataFrame, by: list[str], shift: float = 0.2) -> DataFrame:
    """by, variant, unit, factor: the design of perturbed boards. units: by, unit, operator.

    Each operator is dropped with all its units, each unit is dropped, and each unit's weight is
    moved up and down by the share `shift`; factor is what that adds to the unit's support.
    """
    one = units.select(*by, "unit", "operator").distinct()
    name = lambda kind, column: F.concat(F.lit(f"{kind} "), F.col(column).cast("string"))
    designs = F.array(*[F.struct(v.alias("variant"), F.lit(f).alias("factor")) for v, f in ((name("without operator", "operator"), -1.0), (name("without unit", "unit"), -1.0), (name("less", "unit"), -shift), (name("more", "unit"), shift))])
    return one.select(*by, "unit", F.explode(designs).alias("d")).where("d.variant is not null").select(*by, "d.variant", "unit", "d.factor").distinct()


def variant_support(parts: DataFrame, design: DataFrame, by: list[str]) -> DataFrame:
    """by, variant, a, b, net, shared of each perturbed board and of `ordinal`, which takes signs.

    parts: of `unit_support`. A variant's sums are the board's plus what its units change, so the
    self join of models is not done again. Pairs that share no unit any more stay with nothing.
    """
    board = parts.groupBy(*by, "a", "b").agg(F.sum("part").alias("net"), F.sum("sign").alias("_sign"), F.count("*").alias("shared"))
    moved = parts.join(design, [*by, "unit"]).groupBy(*by, "variant", "a", "b").agg(F.sum(F.col("part") * F.col("factor")).alias("_net"), F.sum(F.when(F.col("factor") == -1, 1).otherwise(0)).alias("_gone"))
    every = board.join(design.select(*by, "variant").distinct(), by).join(moved, [*by, "variant", "a", "b"], "left")
    changed = every.select(*by, "variant", "a", "b", (F.col("net") + F.coalesce("_net", F.lit(0.0))).alias("net"), (F.col("shared") - F.coalesce("_gone", F.lit(0))).alias("shared"))
    changed = changed.withColumn("net", F.when(F.col("shared") > 0, F.col("net")).otherwise(0.0))
    return changed.unionByName(board.select(*by, F.lit("ordinal").alias("variant"), "a", "b", F.col("_sign").alias("net"), "shared"))


def still_qualified(scores: DataFrame, design: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, variant, model of the models that keep `least` units or more in each perturbed board."""
    own = scores.select(*by, "unit", "model").distinct()
    total = own.groupBy(*by, "model").agg(F.count("*").alias("n"))
    lost = own.join(design.where("factor = -1"), [*by, "unit"]).groupBy(*by, "variant", "model").agg(F.count("*").alias("lost"))
    names = design.select(*by, "variant").distinct().unionByName(design.select(*by, F.lit("ordinal").alias("variant")).distinct())
    left = total.join(names, by).join(lost, [*by, "variant", "model"], "left")
    return left.where(F.col("n") - F.coalesce("lost", F.lit(0)) >= least).select(*by, "variant", "model")


def qualified(scores: DataFrame, attributes: list[tuple[str, int]], released: Column | None = None) -> DataFrame:
    """model and a count for each attribute, of the models that reach all its least counts of
    distinct values (sources, families, operators, anchors and so on)."""
    rows = scores if released is None else scores.where(released)
    counted = rows.groupBy("model").agg(*[F.count_distinct(c).alias(f"n_{c}") for c, _ in attributes])
    for c, least in attributes:
        counted = counted.where(F.col(f"n_{c}") >= least)
    return counted


def coverage(scores: DataFrame) -> DataFrame:
    """model, covered: the share of all units' weight that the model has a score in."""
    units = scores.select("unit", "weight").distinct()
    total = units.agg(F.sum("weight").alias("total"))
    return scores.groupBy("model").agg(F.sum("weight").alias("own")).crossJoin(F.broadcast(total)).select("model", F.round(F.col("own") / F.col("total"), 6).alias("covered"))


def agreement(scores: DataFrame, places: DataFrame) -> DataFrame:
    """unit, agreement: the weighted share of a unit's pairs that the published order has the same
    way, ties counting half. places: model, place."""
    placed = scores.join(few(places), "model")
    a = placed.select("unit", F.col("model").alias("m"), F.col("score").alias("s"), F.col("place").alias("p"))
    b = placed.select("unit", F.col("model").alias("n"), F.col("score").alias("t"), F.col("place").alias("q"))
    same = F.signum(F.col("s") - F.col("t")) * F.signum(F.col("q") - F.col("p"))
    return a.join(b, "unit").where("m < n").groupBy("unit").agg(F.round(F.avg((1 + same) / 2), 6).alias("agreement"), F.count("*").alias("pairs"))


def plausible(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """key, rows, rows_before, accepted: a refresh is refused with fewer than half of the rows."""
    a = now.groupBy(key).agg(F.count("*").alias("rows"))
    b = before.groupBy(key).agg(F.count("*").alias("rows_before"))
    return a.join(b, key, "full").select(key, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("rows_before", F.lit(0)).cast("long").alias("rows_before")).withColumn("accepted", 2 * F.col("rows") >= F.col("rows_before"))


def nearest(places: DataFrame, n: int = 5) -> DataFrame:
    """model, other, distance, nth: the n nearest models of each by place; the better one first."""
    a, b = places.select("model", "place"), places.select(F.col("model").alias("other"), F.col("place").alias("at"))
    near = a.join(b, F.col("at").between(F.col("place") - n, F.col("place") + n) & (F.col("model") != F.col("other")))
    near = near.withColumn("distance", F.abs(F.col("at") - F.col("place")))
    nth = F.row_number().over(Window.partitionBy("model").orderBy("distance", "at"))
    return near.withColumn("nth", nth.cast("long")).where(F.col("nth") <= n).select("model", "other", "distance", "nth")


def best_order(cost: np.ndarray, preferred: np.ndarray, sets: int = SETS) -> tuple[list[int], bool]:
    """An order of least total cost, and whether that is proved.

    cost[i, j]: cost of i before j. Among equal orders the one with fewest pairs against
    `preferred`. Parts that no preference cycle joins are ordered by themselves.
    """
    n = len(cost)
    # Scaled so that a whole disagreement with the preferred order is less than any cost.
    against = (preferred[:, None] > preferred[None, :]).astype(float)
    weight = cost + against * 1e-9
    reach = (weight.T > weight) | np.eye(n, dtype=bool)
    for k in range(n):
        reach |= reach[:, [k]] & reach[[k], :]
    parts, seen = [], np.zeros(n, bool)
    for i in sorted(range(n), key=lambda i: (-reach[i].sum(), preferred[i])):
        if not seen[i]:
            part = np.flatnonzero(reach[i] & reach[:, i] & ~seen)
            seen[part] = True
            parts.append(part)
    order, proved = [], True
    for part in parts:
        ranked, exact = least_order(weight[np.ix_(part, part)], sets)
        proved &= exact
        order += [int(part[i]) for i in ranked]
    return order, proved


def total_cost(w: np.ndarray, order: list[int]) -> float:
    return float(np.triu(w[np.ix_(order, order)], 1).sum())


def cycle_packing(d: np.ndarray) -> np.ndarray:
    """y[i, j, k]: weights on cycles of three preferences such that no preference carries more than
    its surplus d[i, j]. Each order reverses a preference of each cycle, so the sum of weights
    within any set of models bounds what ordering the set costs.

    Nearly the most weight, by primal-dual steps on the linear program, scaled until it is feasible
    and then filled up. y is symmetric and counts a cycle once a permutation.
    """
    n = len(d)
    i, j, k = (x.ravel() for x in np.indices((n, n, n)))
    is_cycle = (d[i, j] > 0) & (d[j, k] > 0) & (d[k, i] > 0) & (i < j) & (i < k)
    a, b, c = i[is_cycle], j[is_cycle], k[is_cycle]
    y = np.zeros((n, n, n))
    if not len(a):
        return y
    used, arc = np.unique(np.stack([a * n + b, b * n + c, c * n + a]), return_inverse=True)
    arc = arc.reshape(3, -1)
    room = d.ravel()[used]
    scale = room.max()
    room = room / scale

    def load(x: np.ndarray) -> np.ndarray:
        return np.bincount(arc.ravel(), np.tile(x, 3), minlength=len(used))

    eta = 0.9 / math.sqrt(3 * load(np.ones(len(a))).max())
    x, price, best = np.zeros(len(a)), np.full(len(used), 1 / 3), np.zeros(len(a))
    for r in range(1, 301 + 60 * n):
        ahead = np.maximum(0, x + eta * (1 - price[arc].sum(0)))
        price = np.maximum(0, price + eta * (load(2 * ahead - x) - room))
        x = ahead
        if r % 100 == 0:
            trial = x / np.maximum(1, load(x) / room)[arc].max(0)
            best = trial if trial.sum() > best.sum() else best
    room = np.maximum(0, room * (1 - 1e-12) - load(best))
    for c_ in np.argsort(-best):
        more = room[arc[:, c_]].min()
        best[c_] += more
        room[arc[:, c_]] = np.maximum(0, room[arc[:, c_]] - more)
    for p in ((a, b, c), (b, c, a), (c, a, b)):
        y[p] += best * scale
        y[p[0], p[2], p[1]] += best * scale
    return y


def good_order(w: np.ndarray) -> list[int]:
    """An order that no move of one model makes cheaper, the best of several starts."""
    rng = np.random.default_rng(len(w))

    def settled(order: list[int]) -> list[int]:
        moved = True
        while moved:
            moved = False
            for m in list(order):
                at = order.index(m)
                rest = order[:at] + order[at + 1 :]
                by_place = np.concatenate([[0.0], np.cumsum(w[rest, m] - w[m, rest])])
                to = int(by_place.argmin())
                if by_place[to] < by_place[at] - 1e-12:
                    order, moved = [*rest[:to], m, *rest[to:]], True
        return order

    best = settled([int(i) for i in np.argsort(w.sum(1) - w.sum(0), kind="stable")])
    for _ in range(2 * len(w)):
        trial = list(best)
        for _ in range(max(2, len(w) // 6)):
            trial.insert(int(rng.integers(len(trial))), trial.pop(int(rng.integers(len(trial)))))
        trial = settled(trial)
        if total_cost(w, trial) < total_cost(w, best) - 1e-12:
            best = trial
    return best


def least_order(w: np.ndarray, sets: int = SETS, known: list[int] | None = None) -> tuple[list[int], bool]:
    """An order of least cost w (i before j), and whether that is proved.

    Places are filled from the first on. Of all ways to fill the first ones with the same models
    only the cheapest is kept, and only if it, with the bound of the models left, may still reach
    the best order known. Layers of sets are extended as matrices. With more than `sets` sets in a
    layer the search ends with the best order known, not proved.
    """
    n = len(w)
    if n < 3:
        return ([0, 1] if n == 2 and w[0, 1] <= w[1, 0] else list(range(n))[::-1]), True
    best = known or good_order(w)
    limit = total_cost(w, best)
    slack = 1e-10 * (1 + limit)
    sure = np.minimum(w, w.T)
    over = w - sure
    y = cycle_packing(over.T)
    left, paid, bound = np.ones((1, n), bool), np.array([np.triu(sure, 1).sum()]), np.array([y.sum() / 6])
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(n):
        found: dict[str, list[np.ndarray]] = {"s": [], "v": [], "paid": [], "bound": []}
        for at in range(0, len(left), STEP):
            s = left[at : at + STEP].astype(float)
            new = paid[at : at + STEP, None] + s @ over.T
            rest = bound[at : at + STEP, None] - np.stack([((s @ y[v]) * s).sum(1) for v in range(n)], 1) / 2
            rows, v = np.nonzero(left[at : at + STEP] & (new + rest <= limit + slack))
            for name, values in (("s", rows + at), ("v", v), ("paid", new[rows, v]), ("bound", rest[rows, v])):
                found[name].append(values)
        s, v, new, rest = (np.concatenate(found[name]) for name in ("s", "v", "paid", "bound"))
        after = left[s]
        after[np.arange(len(s)), v] = False
        keys = np.packbits(after, axis=1)
        order = np.lexsort((new, *keys.T))
        first = np.ones(len(order), bool)
        first[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
        kept = order[first]
        if len(kept) > sets or not len(kept):
            return best, not len(kept)
        layers.append((s[kept], v[kept]))
        left, paid, bound = after[kept], new[kept], rest[kept]
    at, out = 0, []
    for s, v in reversed(layers):
        out.append(int(v[at]))
        at = s[at]
    return out[::-1], True


def gap(weight: np.ndarray, order: list[int], k: int, sets: int = SETS) -> tuple[float, bool]:
    """The least extra cost of an order with the k-th and next model of `order` the other way."""
    high, low = order[k], order[k + 1]
    forced = weight.copy()
    forced[high, low] += weight.sum() + 1
    swapped = [*order[:k], low, high, *order[k + 2 :]]
    turned, proved = least_order(forced, sets, swapped)
    return max(0.0, total_cost(weight, turned) - total_cost(weight, order)), proved


def matrix(pairs: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """The models of a board's pairs (a, b, net) and their net support."""
    models = sorted(set(pairs["a"]) | set(pairs["b"]))
    at = {m: i for i, m in enumerate(models)}
    net = np.zeros((len(models), len(models)))
    for a, b, v in zip(pairs["a"], pairs["b"], pairs["net"], strict=True):
        net[at[a], at[b]], net[at[b], at[a]] = v, -v
    return models, net


def board(pairs: pd.DataFrame, anchors: list[str], sets: int = SETS) -> pd.DataFrame:
    """model, place, value, score, optimal of one board's net support (a, b, net).

    value is the reverse running sum of the gaps of neighbours, a gap being the least support that
    an order must reverse beyond the best one's to turn the two; score 100 times the mean logistic
    distance to the anchors, 50 without any. optimal: the order and all gaps are proved.
    """
    models, net = matrix(pairs)
    cost = np.maximum(-net, 0)
    order, optimal = best_order(cost, np.argsort(np.argsort(-net.sum(1), kind="stable"), kind="stable"), sets)
    gaps = [gap(cost, order, k, sets) if net[order[k], order[k + 1]] > 0 else (0.0, True) for k in range(len(order) - 1)]
    values = np.cumsum([0.0, *[g for g, _ in gaps[::-1]]])[::-1]
    base = [values[k] for k, i in enumerate(order) if models[i] in anchors]
    scores = [round(100 * sum(1 / (1 + math.exp(-(v - b))) for b in base) / len(base), 1) if base else 50.0 for v in values]
    proved = optimal and all(p for _, p in gaps)
    return pd.DataFrame({"model": [models[i] for i in order], "place": range(1, len(order) + 1), "value": values, "score": scores, "optimal": proved})


def consensus(net: DataFrame, board_column: str, anchors: list[str]) -> DataFrame:
    """board, model, place, value, score, optimal: each board's order; boards are spread over tasks.
    A board's pairs are at most its models squared, which is small by its nature."""

    def one(pairs: pd.DataFrame) -> pd.DataFrame:
        return board(pairs, anchors).assign(**{board_column: pairs[board_column].iloc[0]})

    kind = net.schema[board_column].dataType.simpleString()
    return net.groupBy(board_column).applyInPandas(one, f"model string, place long, value double, score double, optimal boolean, {board_column} {kind}")


def variant_places(support: DataFrame, places: DataFrame, by: list[str], sets: int = SETS) -> DataFrame:
    """by, variant, model, rank, optimal: each perturbed board's order, one task a board and
    variant. places: by, model, place of the board itself, which equal orders keep to."""
    a = places.select(*by, F.col("model").alias("a"), F.col("place").alias("pa"))
    b = places.select(*by, F.col("model").alias("b"), F.col("place").alias("pb"))
    known = support.join(a, [*by, "a"]).join(b, [*by, "b"])

    def one(pairs: pd.DataFrame) -> pd.DataFrame:
        models, net = matrix(pairs)
        at = dict(zip(pairs["a"], pairs["pa"])) | dict(zip(pairs["b"], pairs["pb"]))
        preferred = np.argsort(np.argsort([at[m] for m in models]))
        order, optimal = best_order(np.maximum(-net, 0), preferred, sets)
        keys = {c: pairs[c].iloc[0] for c in [*by, "variant"]}
        return pd.DataFrame({"model": [models[i] for i in order], "rank": range(1, len(order) + 1), "optimal": optimal}).assign(**keys)

    keys = ", ".join(f"{c} {support.schema[c].dataType.simpleString()}" for c in [*by, "variant"])
    return known.groupBy(*by, "variant").applyInPandas(one, f"model string, rank long, optimal boolean, {keys}")


def stability(support: DataFrame, kept: DataFrame, places: DataFrame, by: list[str], sets: int = SETS) -> DataFrame:
    """by, model, place, rank_from, rank_to, fixed_from, fixed_to, scenarios, unavailable, incomplete.

    The range of a model's ranks over all perturbed boards (support, of `variant_support`), with
    all candidates (fixed) and with those that still qualify there (kept, of `still_qualified`);
    in how many it doesn't, and of how many boards an order is not proved. The board's own place
    belongs to each range.
    """
    ok = kept.withColumn("_ok", F.lit(True))
    left = support.join(ok.withColumnRenamed("model", "a"), [*by, "variant", "a"], "left_semi").join(ok.withColumnRenamed("model", "b"), [*by, "variant", "b"], "left_semi")
    # A variant in which all models still qualify has its order once.
    n = lambda df: df.groupBy(*by, "variant").agg(F.count("*").alias("_n"))
    fewer = n(left).join(n(support), [*by, "variant", "_n"], "left_anti").select(*by, "variant")
    marked = support.withColumn("variant", F.struct("variant", F.lit(True).alias("fixed"))).unionByName(left.join(fewer, [*by, "variant"], "left_semi").withColumn("variant", F.struct("variant", F.lit(False).alias("fixed"))))
    ranked = checkpointed(variant_places(marked.withColumn("variant", F.to_json("variant")), places, by, sets).withColumn("_v", F.from_json("variant", "variant string, fixed boolean")).select(*by, "model", "rank", "optimal", "_v.*"))
    fixed = ranked.where("fixed").select(*by, "variant", "model", F.col("rank").alias("_f"), F.col("optimal").alias("_fo"))
    own = ranked.where("not fixed").select(*by, "variant", "model", F.col("rank").alias("_q"), F.col("optimal").alias("_qo"))
    both = fixed.join(own, [*by, "variant", "model"], "left").join(fewer.withColumn("_fewer", F.lit(True)), [*by, "variant"], "left").join(ok, [*by, "variant", "model"], "left")
    rank = F.when(F.col("_ok"), F.when(F.col("_fewer"), F.col("_q")).otherwise(F.col("_f")))
    proved = F.col("_fo") & F.coalesce("_qo", F.lit(True))
    ranges = both.groupBy(*by, "model").agg(
        F.min(rank).alias("_from"), F.max(rank).alias("_to"), F.min("_f").alias("_low"), F.max("_f").alias("_high"),
        F.count("*").alias("scenarios"), F.sum(F.when(rank.isNull(), 1).otherwise(0)).alias("unavailable"), F.sum(F.when(proved, 0).otherwise(1)).alias("incomplete"),
    )
    wide = lambda pick, c: pick("place", F.coalesce(c, "place")).cast("long")
    return places.select(*by, "model", "place").join(ranges, [*by, "model"], "left").select(
        *by, "model", "place", wide(F.least, "_from").alias("rank_from"), wide(F.greatest, "_to").alias("rank_to"), wide(F.least, "_low").alias("fixed_from"), wide(F.greatest, "_high").alias("fixed_to"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("scenarios", "unavailable", "incomplete")],
    )


def connected(net: DataFrame) -> DataFrame:
    """model, component: the least model that a chain of shared units reaches, by label passing
    until no label moves; models are few."""
    edges = net.where("weight > 0").select("a", "b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.select(F.col("a").alias("model")).distinct().withColumn("component", F.col("model"))
    while True:
        low = both.join(label, F.col("b") == F.col("model")).groupBy("a").agg(F.min("component").alias("low"))
        after = label.join(low, F.col("model") == F.col("a")).select("model", F.least("component", "low").alias("component"))
        after = checkpointed(after)
        if after.exceptAll(label).isEmpty():
            return label
        label = after
