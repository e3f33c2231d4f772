"""What a reader may see: scope, channel, category, window and role filters; sweeps and epochs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import few

HOURS = {"24h": 24, "7d": 168}


@dataclass(frozen=True)
class Industry:
    """What differs from one field of news to another: which stored categories a reader's category
    stands for, the categories of each track, score thresholds by tier, and features that are on."""

    members: dict[str, list[str]] = field(default_factory=dict)
    tracks: dict[str, list[str]] = field(default_factory=dict)
    thresholds: dict[str, int] = field(default_factory=dict)
    features: frozenset[str] = frozenset()

    def categories(self, category: str) -> list[str]:
        return self.members.get(category, [category])

    def threshold(self, tier: Column) -> Column:
        return reduce(lambda out, p: F.when(tier == p[0], p[1]).otherwise(out), self.thresholds.items(), F.lit(None).cast("int"))

    def on(self, feature: str) -> bool:
        return feature in self.features


#: Keys that each kind of source may be configured with; others are refused before anything is read.
SOURCE_KEYS = {
    "rss": {"url", "include", "exclude", "keep_fragment"},
    "json_list": {"url", "items", "fields", "require", "minimum"},
    "web_list": {"url", "selector", "allow", "deny", "pages"},
    "x_search": {"accounts", "query"},
    "account_posts": {"account", "since"},
    "push": {"token_name"},
}


def checked_source(kind: str, config: dict) -> dict:
    """The configuration of a source, if its kind is known and has all these keys."""
    if kind not in SOURCE_KEYS:
        raise ValueError(f"no source is of kind {kind}")
    unknown = sorted(set(config) - SOURCE_KEYS[kind])
    if unknown:
        raise ValueError(f"{kind} has no key {', '.join(unknown)}")
    return config


def source_issue(kind: Column, keys: Column) -> Column:
    """Why `checked_source` refuses a source of a table, by kind and array of keys; null if it doesn't."""
    table = F.create_map(*[c for k, names in SOURCE_KEYS.items() for c in (F.lit(k), F.array(*map(F.lit, sorted(names))))])
    unknown = F.array_sort(F.array_except(keys, table[kind]))
    return F.when(~F.coalesce(kind.isin(*SOURCE_KEYS), F.lit(False)), F.concat(F.lit("no source is of kind "), F.coalesce(kind, F.lit("null")))).when(F.size(unknown) > 0, F.concat(kind, F.lit(" has no key "), F.array_join(unknown, ", ")))


def listed(now: Column) -> Column:
    """Public, and released if selected."""
    return (F.col("visibility") == "public") & (~F.col("selected") | F.coalesce(F.col("visible_after") <= now, F.lit(False)))


def selected(now: Column) -> Column:
    return (F.col("visibility") == "public") & F.col("selected") & F.coalesce(F.col("visible_after") <= now, F.lit(False))


def exported(now: Column) -> Column:
    """Listed, eligible for the pool and no promotion: what leaves the site."""
    return listed(now) & F.col("eligible") & ~F.col("promotion")


def in_channel(channel: str | None) -> Column:
    if channel in (None, "all"):
        return F.lit(True)
    return F.col("first_party") if channel == "firstParty" else F.col("channel") == channel


def in_category(industry: Industry, category: str | None) -> Column:
    return F.lit(True) if category is None else F.col("category").isin(industry.categories(category))


def in_track(industry: Industry, track: str | None) -> Column:
    return F.lit(True) if track is None else F.col("category").isin(industry.tracks[track])


def of_region(rows: DataFrame, sources: DataFrame, region: str | None) -> DataFrame:
    """rows whose source is of the region."""
    return rows if region is None else rows.join(few(sources.where(F.col("region") == region).select("source")), "source", "left_semi")


def in_window(at: Column, window: str, now: Column) -> Column:
    return at.between(now - F.expr(f"INTERVAL {HOURS[window]} HOURS"), now)


def body_mode(site_fulltext: Column, status: Column, has_body: Column) -> Column:
    return F.when(site_fulltext & (status == "ok") & has_body, "full").otherwise("summary")


def redistributable(syndicate: Column, mode: Column) -> Column:
    return syndicate & (mode == "full")


def indexable(visibility: Column, has_summary: Column, is_selected: Column, indexed_at: Column, excluded_at: Column) -> Column:
    return (visibility == "public") & has_summary & excluded_at.isNull() & (is_selected | indexed_at.isNotNull())


def has_page(visibility: Column, mode: Column) -> Column:
    return (visibility != "withdrawn") & (mode == "editorial")


def minimal(payload: Column) -> Column:
    """A payload struct without its wide fields and the link to the original."""
    return payload.dropFields("original_title", "summary", "reason", "attribution", "links.original")


def unheld(items: DataFrame, jobs: DataFrame, now: Column, wait_minutes: int = 3, stale_hours: int = 6, most: int = 500) -> DataFrame:
    """id of the items that wait for processing and that no queue holds, the latest first.

    items: id, state, created, discovered, retry_at, queued_at. jobs: key, state.
    """
    due = F.col("retry_at").isNull() | (F.col("retry_at") <= now)
    lost = F.col("queued_at").isNull() | (F.col("queued_at") < now - F.expr(f"INTERVAL {stale_hours} HOURS"))
    waiting = items.where((F.col("state") == "new") & (F.col("created") < now - F.expr(f"INTERVAL {wait_minutes} MINUTES")) & due & lost)
    held = jobs.where(F.col("state").isin("created", "retry", "active")).select(F.col("key").alias("id"))
    return waiting.join(held, "id", "left_anti").orderBy(F.col("discovered").desc(), "id").limit(most).select("id")


def since_epoch(cursors: DataFrame, epoch: str) -> DataFrame:
    """reader, answer, seq: what each reader's cursor `epoch.seq` is worth. A cursor of another
    epoch, from before the ledger was built anew, calls for a new snapshot."""
    parts = F.split("cursor", r"\.")
    same = (F.size(parts) == 2) & (parts[0] == epoch) & parts[1].rlike("^[0-9]{1,18}$")
    return cursors.select("reader", F.when(same, "changes").otherwise("snapshot").alias("answer"), F.when(same, F.get(parts, F.lit(1)).try_cast("long")).alias("seq"))
