"""Periodic reports: candidates of a window, sections, flashes, quotas, catch-up and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import distinct_on, first_of_each

# Fixed values of the composition rule.
SECTION, FLASHES, REPEAT_DAYS = 8, 12, 7


def members(items: DataFrame, start: Column, end: Column) -> DataFrame:
    """Selected public items, no backfill, that arrived or were released, whichever is later, in
    [start, end). items: id, fact, at, visible_after, public, selected, backfill and more."""
    arrived = F.greatest("at", F.coalesce("visible_after", "at"))
    return items.where(F.col("public") & F.col("selected") & ~F.col("backfill") & (arrived >= start) & (arrived < end))


def one_per_fact(rows: DataFrame) -> DataFrame:
    """The first party's or best scored item of each fact; an item without a fact stands for itself."""
    keyed = rows.withColumn("fact_key", F.coalesce(F.concat(F.lit("f:"), F.col("fact").cast("string")), F.concat(F.lit("a:"), F.col("id").cast("string"))))
    return distinct_on(keyed, ["fact_key"], F.col("first_party").desc(), F.col("score").desc_nulls_last(), F.col("id"))


def fresh(rows: DataFrame, history: DataFrame, day: Column, days: int = REPEAT_DAYS) -> DataFrame:
    """rows whose fact_key no report of the last days has. history: day, fact_keys (array)."""
    past = history.where((F.col("day") < day) & (F.col("day") >= F.date_sub(day, days))).select(F.explode("fact_keys").alias("fact_key"))
    return rows.join(past.distinct(), "fact_key", "left_anti")


def compose(rows: DataFrame) -> DataFrame:
    """id, track, section, slot, place: the first of each section by score, then the flashes of each
    track in the order of the list; the rest is left out."""
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("track", "section").orderBy(*order)))
    inside = ranked.where(F.col("_n") <= SECTION).select("id", "track", "section", F.lit("section").alias("slot"), F.col("_n").cast("long").alias("place"))
    flashes = first_of_each(ranked.where(F.col("_n") > SECTION), ["track"], order, FLASHES)
    return inside.unionByName(flashes.select("id", "track", "section", F.lit("flash").alias("slot"), "place"))


def due(first: Column, now: Column, stored: DataFrame, spark) -> DataFrame:
    """day: the daily reports that are due by now (08:00 in Beijing) and not stored."""
    last = F.to_date(now)  # 08:00 there is midnight UTC
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return days.join(stored, "day", "left_anti")


def neighbours(reports: DataFrame, kind: str, key: str) -> DataFrame:
    w = Window.partitionBy(kind).orderBy(key)
    return reports.withColumn("previous", F.lag(key).over(w)).withColumn("next_one", F.lead(key).over(w))


def read(entries: DataFrame, items: DataFrame) -> DataFrame:
    """entries (report, id, place) with the item's title and whether it can still be cited."""
    live = items.select("id", "title", F.col("public").alias("available"))
    joined = entries.join(live, "id", "left")
    return joined.withColumn("available", F.coalesce("available", F.lit(False))).withColumn("headline", F.coalesce(F.nullif("title", F.lit("")), F.lit("(withdrawn)")))
