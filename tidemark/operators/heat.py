"""Story heat: participants counted once, decayed with a half-life, ranked, capped and kept by hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.math import decay, heat_index

# Fixed values of the ranking rule.
WINDOW_HOURS, HALF_LIFE, BEFORE_HOURS, UNSCORED, MIN_PARTICIPANTS = 168, 72, 6, 0.5, 2
LIST_SIZE, SINGLE_CAP, TRACK_FLOOR, NAMES = 10, 2, 3, 8


def hours_before(at: Column, hours: int) -> Column:
    return at - F.expr(f"INTERVAL {hours} HOURS")


def heat(signals: DataFrame, at: Column, extra: list[str] | None = None) -> DataFrame:
    """Heat of each story at a time, and six hours before.

    signals: story, participant, seen, weight, editorial, behind (its source is not fully observed).
    Returns story, *extra, participants, heat, heat_before, heat_observed, heat_before_observed,
    behind_participants, recent, editorial_participants, signal_participants; stories without a
    participant in the window are left out. Participants are folded first, partly in every task,
    so a story that everyone talks about is spread over its participants. extra: further keys, for
    instance the hour that a row of signals is counted for, with `at` an expression of them.
    """
    keys = [*(extra or []), "story"]
    before = hours_before(at, BEFORE_HOURS)
    now_in, old_in = F.col("seen") > hours_before(at, WINDOW_HOURS), F.col("seen") <= before
    rows = signals.where((F.col("seen") > hours_before(before, WINDOW_HOURS)) & (F.col("seen") <= at))
    only = lambda cond, x: F.when(cond, x)
    per = rows.groupBy(*keys, "participant").agg(
        F.max(only(now_in, F.col("seen"))).alias("last"), F.min(only(now_in, F.col("seen"))).alias("first"), F.max(only(old_in, F.col("seen"))).alias("last_old"),
        F.bool_or(only(now_in, F.col("editorial"))).alias("editorial"), F.bool_or(only(now_in, F.col("behind"))).alias("behind"), F.bool_or(only(old_in, F.col("behind"))).alias("behind_old"),
        F.max(only(now_in, F.col("weight"))).alias("w"), F.max(only(old_in, F.col("weight"))).alias("w_old"))
    current = F.col("w") * decay(at, F.col("last"), HALF_LIFE)
    past = F.when(F.col("last_old") > hours_before(before, WINDOW_HOURS), F.col("w_old") * decay(before, F.col("last_old"), HALF_LIFE))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return per.groupBy(*keys).agg(
        F.count("last").alias("participants"), zero(current).alias("heat"), zero(past).alias("heat_before"),
        zero(only(~F.col("behind"), current)).alias("heat_observed"), zero(only(~F.col("behind_old"), past)).alias("heat_before_observed"),
        F.count_if(F.col("behind")).alias("behind_participants"), F.count_if(F.col("first") > before).alias("recent"),
        F.count_if(F.col("editorial")).alias("editorial_participants"), F.count_if(~F.col("editorial")).alias("signal_participants"),
    ).where("participants > 0")


def weighted(heats: DataFrame, quality: DataFrame) -> DataFrame:
    """heats times the story's quality (its best score / 100, UNSCORED where it has none), and selected.

    quality: story, score (0 to 100 or null), selected, of the story's visible reports."""
    best = quality.groupBy("story").agg(F.max("score").alias("_score"), F.bool_or("selected").alias("_selected"))
    q = F.coalesce(F.col("_score") / 100, F.lit(UNSCORED))
    names = ["heat", "heat_before", "heat_observed", "heat_before_observed"]
    joined = heats.join(best, "story", "left")
    return joined.withColumns({n: F.col(n) * q for n in names}).withColumn("selected", F.coalesce("_selected", F.lit(False))).drop("_score", "_selected")


def candidates(weighted_heats: DataFrame) -> DataFrame:
    """Stories that an editorial source reports, and that two participants do or that are selected."""
    return weighted_heats.where((F.col("editorial_participants") >= 1) & ((F.col("participants") >= MIN_PARTICIPANTS) | F.col("selected")))


def trends(rows: DataFrame, at: Column, first_report: str) -> DataFrame:
    """rows with index, trend, trend_pct, surge, is_new, rising. Where a source is behind, only
    participants that were observed throughout are compared."""
    some_behind = F.col("behind_participants") > 0
    now = F.when(some_behind, heat_index(F.col("heat_observed"))).otherwise(heat_index(F.col("heat")))
    old = F.when(some_behind, heat_index(F.col("heat_before_observed"))).otherwise(heat_index(F.col("heat_before")))
    pct = F.when(old > 0, (now - old) / old)
    trend = F.when(heat_index(F.col("heat_before")) <= 0, "new").when(pct.isNull(), "unknown").when(pct > 0.1, "up").when(pct < -0.1, "down").otherwise("flat")
    surge = (F.col("recent") >= 3) & (F.col("recent") / F.col("participants") >= 0.5)
    return rows.select(
        "*", heat_index(F.col("heat")).alias("index"), trend.alias("trend"), (F.floor(pct * 1000 + 0.5) / 10).alias("trend_pct"), surge.alias("surge"),
        (F.col(first_report) > hours_before(at, BEFORE_HOURS)).alias("is_new"), (~surge & F.coalesce(pct > 0.15, F.lit(False))).alias("rising"))


def behind_sources(clocks: DataFrame, at: Column, grace: bool) -> DataFrame:
    """source of the clocks (source, last_ok, interval_minutes) that had no success in time."""
    allow = F.greatest(3 * F.col("interval_minutes"), F.lit(90)) if grace else F.lit(0)
    return clocks.where(F.col("last_ok").isNull() | (F.timestamp_diff("SECOND", F.col("last_ok"), at) > allow * 60)).select("source")


def combined_list(ranked: DataFrame, tracks: list[str], size: int = LIST_SIZE, floor: int = TRACK_FLOOR, cap: int = SINGLE_CAP) -> DataFrame:
    """story, place of the list of all tracks: `floor` places a track first, then the hottest, with
    at most cap stories that one source reports alone.

    ranked: story, heat, latest, source, single, tracks (array). The greedy pick needs few rows:
    of each track and of all, the first ones in order, so many that the cap can't run them out.
    Those are folded in one task.
    """
    import pandas as pd

    order = [F.col("heat").desc(), F.col("latest").desc(), F.col("story")]
    # Within a source's single stories only the first can be picked, `cap` for each pass over the list.
    nth = F.row_number().over(Window.partitionBy("source", "single").orderBy(*order))
    able = ranked.withColumn("_nth", nth).where(~F.col("single") | (F.col("_nth") <= size)).drop("_nth")
    heads = able.orderBy(*order).limit(size * (size + 1))
    for t in tracks:
        heads = heads.unionByName(able.where(F.array_contains("tracks", t)).orderBy(*order).limit(size * (size + 1)))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        items = rows.drop_duplicates("story").sort_values(["heat", "latest", "story"], ascending=[False, False, True]).to_dict("records")

        def free(picked, c):
            return not c["single"] or sum(p["single"] and p["source"] == c["source"] for p in picked) < cap

        def top(rows_):
            out = []
            for c in rows_:
                if len(out) < size and free(out, c):
                    out.append(c)
            return out

        picked = []
        for t in tracks:
            filled = 0
            for c in top([c for c in items if t in c["tracks"]]):
                if filled >= floor:
                    break
                if c in picked:
                    filled += 1
                elif free(picked, c) and len(picked) < size:
                    picked.append(c)
                    filled += 1
        for c in items:
            if len(picked) < size and c not in picked and free(picked, c):
                picked.append(c)
        picked.sort(key=items.index)
        return pd.DataFrame({"story": [p["story"] for p in picked], "place": range(1, len(picked) + 1)})

    kind = ranked.schema["story"].dataType.simpleString()
    return heads.select("story", "heat", "latest", "source", "single", "tracks", F.lit(1).alias("_one")).groupBy("_one").applyInPandas(fold, f"story {kind}, place long")


def hourly(signals: DataFrame, hours: DataFrame) -> DataFrame:
    """heat of every story at every hour of `hours` (hour): each signal is copied to the hours whose
    window it is in, all hours in one pass."""
    dated = signals.crossJoin(F.broadcast(hours)).where((F.col("seen") <= F.col("hour")) & (F.col("seen") > hours_before(F.col("hour"), WINDOW_HOURS + BEFORE_HOURS)))
    return heat(dated, F.col("hour"), ["hour"])


def repair(snapshots: DataFrame, computed: DataFrame) -> DataFrame:
    """story, hour, heat, complete: snapshots with incomplete hours replaced by computed ones."""
    both = snapshots.join(computed.select("story", "hour", F.col("heat").alias("_new")), ["story", "hour"], "full")
    use = ~F.coalesce("complete", F.lit(False)) & F.col("_new").isNotNull()
    return both.select("story", "hour", F.when(use, F.col("_new")).otherwise(F.col("heat")).alias("heat"), (F.coalesce("complete", F.lit(False)) | use).alias("complete"))


def sparkline(hourly_heat: DataFrame, at: Column, slots: int = 25) -> DataFrame:
    """story, points: an entry for each of the last hours, null where there is none."""
    start = F.date_trunc("hour", at).cast("timestamp_ntz") - F.make_interval(hours=F.lit(slots - 1))
    place = F.timestamp_diff("HOUR", start, F.col("hour")).cast("int")
    points = F.map_from_entries(F.collect_list(F.struct("_at", "heat")))
    rows = hourly_heat.withColumn("_at", place).where(F.col("_at").between(0, slots - 1)).groupBy("story").agg(points.alias("m"))
    return rows.select("story", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.try_element_at("m", k)).alias("points"))
