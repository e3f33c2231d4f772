"""Listing filters with reasons, and run-time rules of collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def noise_reason(title: Column, excerpt: Column, categories: Column, rules: dict[str, list[str]]) -> Column:
    """Why a candidate is dropped, or null. rules: deny, allow, require, keep, drop_title, drop.

    Words are matched anywhere in the lower-case title and excerpt. A required word that is missing
    drops first; a word to keep saves what later rules would drop.
    """
    low = F.lower(title)
    hay = F.concat_ws("\n", low, F.lower(F.coalesce(excerpt, F.lit(""))))

    def has(text: Column, name: str) -> Column:
        words = [w.lower() for w in rules.get(name) or []]
        return F.exists(F.lit(words), lambda w: F.contains(text, w)) if words else F.lit(False)

    cats = F.coalesce(categories, F.array().cast("array<string>"))
    denied = F.get(F.filter(F.lit(rules.get("deny") or ["\u0000"]), lambda x: F.array_contains(cats, x)), F.lit(0))
    out = F.when(denied.isNotNull(), F.concat(F.lit("denyCategory:"), denied))
    if rules.get("allow"):
        out = out.when(~F.arrays_overlap(cats, F.lit(rules["allow"])), "allowCategory")
    if rules.get("require"):
        out = out.when(~has(hay, "require"), "requireMarkers")
    return out.when(has(hay, "keep"), F.lit(None)).when(has(low, "drop_title"), "dropMarkersTitleOnly").when(has(hay, "drop"), "dropMarkers")


def overflowed(now: DataFrame, before: DataFrame, key: str, least: int = 5, by: str | None = None) -> DataFrame:
    """by, n, known, overflow: a full listing that shares nothing with the one before has lost items.
    by: a column of both that tells listings apart."""
    names = [by, key] if by else [key]
    marked = now.select(*names).distinct().join(before.select(*names).distinct().withColumn("_b", F.lit(True)), names, "left")
    counted = marked.groupBy(*names[:-1]).agg(F.count("*").alias("n"), F.count("_b").alias("known"))
    return counted.withColumn("overflow", (F.col("n") >= least) & (F.col("known") == 0))


def first_import(candidates: DataFrame, at: str, now: Column, n: int = 30, months: int = 12, by: str | None = None) -> DataFrame:
    """The latest n candidates of the last months, or without a date; with `by`, of each of its
    values. n and months are how much a source's first reading takes in."""
    recent = candidates.where(F.col(at).isNull() | (F.col(at) >= F.add_months(now, -months)))
    if by is None:
        return recent.orderBy(F.col(at).desc_nulls_last()).limit(n)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.col(at).desc_nulls_last()))
    return recent.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")
