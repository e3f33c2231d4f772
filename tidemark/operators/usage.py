"""Usage, budgets, rhythm and alert analytics over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budgets(calls: DataFrame, service: str, at: str) -> DataFrame:
    """service, per_minute, per_hour, per_day and wait_s, the seconds until the hour's first call
    leaves the hour; as of the latest call of all. One pass, partial sums by service."""
    now = calls.agg(F.max(at).alias("_now"))
    dated = calls.crossJoin(F.broadcast(now))
    since = lambda unit: F.col(at) > F.col("_now") - F.expr(f"INTERVAL 1 {unit}")
    recent = dated.where(since("DAY"))
    first = F.min(F.when(since("HOUR"), F.col(at)))
    # Whole seconds, halves up, of the time since then.
    seconds = F.round(F.timestamp_diff("MICROSECOND", first, F.max("_now")) / 1e6).cast("long")
    return recent.groupBy(service).agg(
        F.count_if(since("MINUTE")).alias("per_minute"), F.count_if(since("HOUR")).alias("per_hour"), F.count("*").alias("per_day"),
        F.greatest(F.lit(0).cast("long"), 3600 - seconds).alias("wait_s"))


def usage(calls: DataFrame, keys: list[str], latency: str, ok: Column, cost: Column) -> DataFrame:
    """keys, calls, ok, failed, p50, p95 (discrete) and cost."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {latency})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})").alias("p95"),
        F.round(F.sum(cost), 4).alias("cost"))


def rhythm(deliveries: DataFrame, source: str, at: str, now: Column, days: int = 90, least: int = 4, multiple: float = 5.0) -> DataFrame:
    """source, days, median_gap, quiet_days, quiet_multiple, overdue: how regular a source delivers.

    Counts distinct Beijing days of the last `days`; a source is overdue if it has been quiet for
    more than `multiple` of its median gap and has `least` days of evidence.
    """
    day = F.to_date(F.col(at) + F.expr("INTERVAL 8 HOURS"))
    seen = deliveries.where((F.col(at) > now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(at) <= now)).select(source, day.alias("_day")).distinct()
    gap = F.datediff("_day", F.lag("_day").over(Window.partitionBy(source).orderBy("_day")))
    per = seen.withColumn("_gap", gap).groupBy(source).agg(F.count("*").alias("days"), F.percentile("_gap", 0.5).alias("median_gap"), F.max("_day").alias("_last"))
    quiet = F.datediff(F.to_date(now + F.expr("INTERVAL 8 HOURS")), "_last").cast("long")
    out = per.withColumn("quiet_days", quiet).withColumn("quiet_multiple", F.round(F.col("quiet_days") / F.col("median_gap"), 4)).drop("_last")
    return out.withColumn("overdue", F.coalesce((F.col("days") >= least) & (F.col("quiet_days") > multiple * F.col("median_gap")), F.lit(False)))


def alerts(counts: DataFrame, rules: list[tuple[str, str, Column]], key: str, open_now: DataFrame) -> DataFrame:
    """key, rule, severity, state: what a union of rules finds against what is open already.

    rules: name, severity, predicate. state is new, repeated or, for open ones no rule finds, recovered.
    open_now: key, rule.
    """
    found = F.array(*[F.when(p, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rules])
    rows = counts.select(key, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("_r")).select(key, "_r.rule", "_r.severity")
    both = rows.join(open_now.withColumn("_open", F.lit(True)), [key, "rule"], "full")
    state = F.when(F.col("severity").isNull(), "recovered").when(F.col("_open").isNotNull(), "repeated").otherwise("new")
    return both.select(key, "rule", "severity", state.alias("state"))


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS"))
