"""Materials, revisions, the public projection and its ledger."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import few

# Fixed values of the timeline rule and the release gate.
STALE_HOURS, FUTURE_HOURS, GATE_SECONDS = 48, 1, 180


def timeline(claimed: Column, discovered: Column, explicit: Column) -> Column:
    """struct published, timeline_at, backfill, reason.

    A claimed time over an hour ahead is not trusted. Material with an explicit reason, or found
    over 48 hours late, is a backfill and is filed at its own time, if known.
    """
    known = F.when(claimed <= discovered + F.expr(f"INTERVAL {FUTURE_HOURS} HOURS"), claimed)
    stale = discovered > known + F.expr(f"INTERVAL {STALE_HOURS} HOURS")
    reason = F.coalesce(explicit, F.when(stale, "stale-on-discovery"))
    at = F.when(reason.isNotNull() & known.isNotNull(), known).otherwise(discovered)
    return F.struct(known.alias("published"), at.alias("timeline_at"), reason.isNotNull().alias("backfill"), reason.alias("reason"))


def is_historical(backfill: Column, published: Column, discovered: Column) -> Column:
    return backfill & (published.isNull() | (discovered > published + F.expr(f"INTERVAL {STALE_HOURS} HOURS")))


def revisions(listings: DataFrame) -> DataFrame:
    """identity, revision, hash, discovered: the versions of each material.

    listings: identity, source, discovered, hash. The source that found a material first owns it;
    other sources only discover it. A hash that was seen before is no revision.
    """
    first = F.min(F.struct("discovered", "source"))["source"].alias("owner")
    owned = listings.join(listings.groupBy("identity").agg(first), "identity").where(F.col("source") == F.col("owner"))
    versions = owned.groupBy("identity", "hash").agg(F.min("discovered").alias("discovered"))
    number = F.row_number().over(Window.partitionBy("identity").orderBy("discovered", "hash"))
    return versions.withColumn("revision", number.cast("long"))


OUTCOMES = "identity string, source string, discovered timestamp_ntz, outcome string, revision long, hash string"


def _collapsed(s: str | None) -> str:
    return re.sub(r"\s+", " ", s or "", flags=re.ASCII).strip(" ")


def _content_hash(title: str, body: str | None, excerpt: str | None) -> str:
    return hashlib.sha256("\u0001".join(map(_collapsed, (title, body, excerpt))).encode()).hexdigest()


def _same_but_for_loss(a: str | None, b: str | None) -> bool:
    x, y = (re.sub("\ufffd+", "\ufffd", _collapsed(s)) for s in (a, b))
    return len(x) == len(y) and all(p == q or "\ufffd" in (p, q) for p, q in zip(x, y, strict=True))


def versions(listings: DataFrame) -> DataFrame:
    """identity, source, discovered, outcome, revision, hash: what each listing does to its material.

    listings: identity, source, discovered, title, body, excerpt, imported. They are read in the
    order of discovery (then source, title, body), identity by identity, as a sorted stream: held
    are a material's texts and the hashes it had. The first listing creates it, and its source owns
    it; one of another source is a `discovery` only. A body or excerpt that is null keeps the one
    held. Then, the first that holds: the hash is the current one (`unchanged`); the material was
    imported without a hash and takes this one as its `baseline`; the hash was there before
    (`seen`); nothing differs but characters lost on one side (`lossy`); else it is `revised`.
    """
    names = [f.split()[0] for f in OUTCOMES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if held.get("identity") != r.identity:
                    held = {"identity": r.identity, "source": r.source, "texts": (r.title, r.body, r.excerpt), "hash": None if r.imported else _content_hash(r.title, r.body, r.excerpt), "revision": 1}
                    held["had"] = {held["hash"]}
                    outcome = "created"
                elif held["source"] != r.source:
                    outcome = "discovery"
                else:
                    texts = (r.title, held["texts"][1] if r.body is None else r.body, held["texts"][2] if r.excerpt is None else r.excerpt)
                    new = _content_hash(*texts)
                    if new == held["hash"]:
                        outcome = "unchanged"
                    elif held["hash"] is None:
                        outcome = "baseline"
                        held["hash"] = new
                        held["texts"] = (*held["texts"][:2], held["texts"][2] if held["texts"][2] is not None else r.excerpt)
                    elif new in held["had"]:
                        outcome = "seen"
                    elif all(map(_same_but_for_loss, held["texts"], texts)):
                        outcome = "lossy"
                    else:
                        outcome = "revised"
                        held |= {"hash": new, "texts": texts, "revision": held["revision"] + 1}
                    held["had"].add(held["hash"])
                out.append((r.identity, r.source, r.discovered, outcome, held["revision"], held["hash"]))
            yield pd.DataFrame(out, columns=names)

    order = ["identity", "discovered", "source", "title", "body"]
    rows = listings.select("identity", "source", "discovered", "title", "body", "excerpt", "imported")
    return rows.repartition("identity").sortWithinPartitions(*order).mapInPandas(run, OUTCOMES)


def discoveries(listings: DataFrame) -> DataFrame:
    """identity, source, first_seen, times: every entrance by which a material came."""
    return listings.groupBy("identity", "source").agg(F.min("discovered").alias("first_seen"), F.count("*").alias("times"))


def repaired_identities(articles: DataFrame, key: Column, better: list[Column]) -> DataFrame:
    """id, survivor: where each article's identity group ends, by the order of `better`, then id."""
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*better, "id"))
    keyed = articles.withColumn("_key", key).withColumn("_place", place)
    best = keyed.where("_place = 1").select("_key", F.col("id").alias("survivor"))
    return keyed.join(best, "_key").select("id", "survivor")


def rekeyed(bridge: DataFrame, column: str, survivors: DataFrame) -> DataFrame:
    """bridge rows moved to their survivors, each once."""
    moved = survivors.select(F.col("id").alias("_id"), "survivor")
    return bridge.join(moved, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("survivor", column)).drop("_id", "survivor").distinct()


def overridden(manual: Column, judged: Column) -> Column:
    """A manual value, unless it is empty, before a judged one."""
    return F.coalesce(F.nullif(F.trim(manual), F.lit("")), judged)


def pool_eligible(mode: Column, relevance: Column, title: Column, summary: Column, score: Column, floor: Column) -> Column:
    named = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(summary, F.lit("")) != "")
    return (mode == "editorial") & F.coalesce(relevance == "pass", F.lit(False)) & named & (floor.isNull() | F.coalesce(score >= floor, F.lit(False)))


def selectable(eligible: Column, judged: Column, tier: Column, promotion: Column) -> Column:
    return eligible & F.coalesce(judged, F.lit(False)) & (tier != "EXCLUDE_MP") & ~promotion


def is_promotion(override: Column, judged: Column) -> Column:
    return F.coalesce(override, judged, F.lit(False))


def project(articles: DataFrame, analyses: DataFrame, overrides: DataFrame, sources: DataFrame, members: DataFrame) -> DataFrame:
    """The public projection: one row an article, from its latest judgement and what editors set.

    articles: id, source, timeline_at, discovered, title, duplicate_of. analyses: id, revision,
    analysis, title, summary, score, relevance, selected, promotion. overrides: id, title_set,
    selected_set, promotion_set. sources: source, mode, tier, floor. members: id, fact.
    Returns id, source, title, summary, score, eligible, selected, promotion, visible_after,
    sort_at. A selected item is released at once if it is grouped, else after the gate. sort_at is
    the earliest time among it and the other eligible items of its fact, for selected items.
    """
    last = F.max(F.struct("revision", "analysis", "title", "summary", "score", "relevance", "selected", "promotion")).alias("a")
    latest = analyses.groupBy("id").agg(last).select("id", "a.*").withColumnsRenamed({"title": "judged_title", "selected": "judged"}).drop("revision", "analysis").withColumnRenamed("promotion", "judged_promotion")
    wide = articles.where("duplicate_of is null").join(latest, "id", "left").join(overrides, "id", "left").join(few(sources), "source").join(members, "id", "left")
    title = overridden(F.col("title_set"), F.coalesce("judged_title", "title"))
    promotion = is_promotion(F.col("promotion_set"), F.col("judged_promotion"))
    rows = wide.withColumn("title", title).withColumn("promotion", promotion)
    rows = rows.withColumn("eligible", pool_eligible(F.col("mode"), F.col("relevance"), F.col("title"), F.col("summary"), F.col("score"), F.col("floor")))
    rows = rows.withColumn("selected", selectable(F.col("eligible"), F.coalesce("selected_set", "judged"), F.col("tier"), F.col("promotion")))
    gate = F.when(F.col("fact").isNotNull(), F.col("discovered")).otherwise(F.col("discovered") + F.expr(f"INTERVAL {GATE_SECONDS} SECONDS"))
    earliest = rows.where("eligible and fact is not null").groupBy("fact").agg(F.min("timeline_at").alias("_first"))
    anchored = rows.join(earliest, "fact", "left")
    sort_at = F.when(F.col("selected"), F.least("timeline_at", "_first")).otherwise(F.col("timeline_at"))
    return anchored.select("id", "source", "title", "summary", "score", "eligible", "selected", "promotion", F.when(F.col("selected"), gate).alias("visible_after"), sort_at.alias("sort_at"))


def watermark(ledger: DataFrame, now: Column) -> DataFrame:
    """seq: up to where all rows are visible. ledger: seq, visible_at."""
    hidden, last = F.min(F.when(F.col("visible_at") > now, F.col("seq"))), F.max("seq")
    return ledger.agg(F.coalesce(hidden - 1, last, F.lit(0)).cast("long").alias("watermark"))


def snapshot(ledger: DataFrame, upto: Column, members: DataFrame) -> DataFrame:
    """The last row of each key up to a seq, if it is an upsert and its key is in the set still."""
    last = ledger.where(F.col("seq") <= upto).groupBy("key").agg(F.max(F.struct("seq", "op"))["seq"].alias("seq"), F.max(F.struct("seq", "op"))["op"].alias("op"))
    return last.where("op = 'upsert'").join(members, "key", "left_semi")


def changes_after(ledger: DataFrame, cursor: int, upto: Column, n: int) -> DataFrame:
    """The first n rows with cursor < seq <= upto, in order."""
    return ledger.where((F.col("seq") > cursor) & (F.col("seq") <= upto)).orderBy("seq").limit(n)


def released(selected: Column, visible_after: Column, now: Column) -> Column:
    return ~selected | (visible_after <= now)


def listed(visibility: Column, selected: Column, visible_after: Column, now: Column) -> Column:
    return (visibility == "public") & released(selected, visible_after, now)
