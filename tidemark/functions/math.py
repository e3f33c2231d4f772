"""Scores, weights, vectors and thresholds as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Selection thresholds by tier, and by tier for the academic track.
THRESHOLDS = {"T1": 60, "T1_5": 65, "T2": 76}
ACADEMIC = {"T1": 60, "T1_5": 65, "T2": 67}


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def decay(at: Column, then: Column, half_life_hours: float) -> Column:
    hours = F.timestamp_diff("MICROSECOND", then, at) / 3.6e9
    return F.pow(F.lit(0.5), hours / half_life_hours)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1 in the same direction; null and zero vectors stay as they are."""
    # One element, so that the length is worked out once a row.
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def engagement_weight(likes: Column, collects: Column, comments: Column, shares: Column, scale: float = 4, most: float = 2) -> Column:
    """1 to `most`; counts that are null or negative add nothing."""
    n = lambda c: F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(most), 1 + F.log10(1 + n(likes) + 2 * n(collects) + 3 * n(comments) + 3 * n(shares)) / scale)


def heat_index(heat: Column) -> Column:
    return F.floor(heat * 100 + 0.5) / 10


def dims_display(total: Column) -> Column:
    """The sum of five dimensions of 1 to 4 on a scale to 100."""
    return js_round((total - 5) / 15 * 100)


def role_score(relevance: Column, action: Column, novelty: Column, verdict: Column) -> Column:
    return relevance + action + novelty + 3 * verdict


def expected_role_score(p_must: Column, p_maybe: Column) -> Column:
    return 2 * p_must + p_maybe


def mean_passes(a: Column, b: Column, threshold: Column) -> Column:
    """Both scores together reach the threshold twice."""
    return a + b >= 2 * threshold


def threshold(tier: Column, track: Column) -> Column:
    table = lambda m: F.create_map(*[F.lit(x) for p in m.items() for x in p])
    return F.when(track == "academic", table(ACADEMIC)[tier]).otherwise(table(THRESHOLDS)[tier])


def adaptive_interval(per_day: Column, least: int, most: int, configured: Column) -> Column:
    """Minutes between fetches: a third of the mean gap within bounds, the longest for rare sources."""
    minutes = js_round(F.greatest(F.lit(least), F.least(F.lit(most), 1440 / (3 * per_day))))
    return F.greatest(F.when(per_day <= 0.15, most).otherwise(minutes), configured)


def backoff(failures: Column, base: float, most: float) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), failures - 1))


def jitter(key: Column, spread: int) -> Column:
    """0 to spread - 1, the same for the same key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % spread


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2)))


def soft_support(delta: Column, error: Column) -> Column:
    """2 Phi(delta / error) - 1, or the sign of delta where the error is unknown or 0."""
    # The divisor is null, not 0, where the branch is not taken: parts of it may be computed first.
    return F.when(error > 0, 2 * normal_cdf(delta / F.when(error > 0, error)) - 1).otherwise(F.signum(delta))


def token_cost(prompt: Column, cached: Column, output: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """Cost with prices for a million tokens; cached ones are part of the prompt."""
    hit = F.least(F.coalesce(cached, F.lit(0)), prompt)
    return ((prompt - hit) * price_in + hit * F.coalesce(price_cached, price_in) + output * price_out) / 1e6
