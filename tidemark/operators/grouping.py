"""Which fact and story a report joins: signals, links and verdicts in their order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed

# What a signal needs to be joined by itself or to be judged, and how far links look back.
AUTO, JUDGED, SIGNAL_TOP, LINK_DAYS = 0.92, 0.72, 4, 120

#: The outcomes of a report, the first that holds wins.
ORDER = ["skipped", "manual", "archived", "signal", "standalone", "kept", "not_relevant", "same_url", "same_fact", "development", "roundup", "new_story"]


def grouping(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, action, fact for each report, in one pass over a batch.

    reports: id, duplicate_of, manual_fact, historical, is_signal, promotion, current_fact, relevance,
    url_fact. verdicts: query (a report's id), action (same, development, roundup), fact, of
    relation rules. A batch's reports don't see each other: what they share is merged afterwards
    by roots, which does not depend on the order of their arrival.
    """
    v = verdicts.select(F.col("query").alias("_q"), F.col("action").alias("_a"), F.col("fact").alias("_f"))
    tests: list[tuple[str, Column]] = [
        ("skipped", F.col("duplicate_of").isNotNull()), ("manual", F.col("manual_fact").isNotNull()), ("archived", F.col("historical")), ("signal", F.col("is_signal")),
        ("standalone", F.col("promotion")), ("kept", F.col("current_fact").isNotNull()), ("not_relevant", F.col("relevance") != "pass"), ("same_url", F.col("url_fact").isNotNull()),
        ("same_fact", F.col("_a") == "same"), ("development", F.col("_a") == "development"), ("roundup", F.col("_a") == "roundup")]
    action = F.lit("new_story")
    for name, cond in reversed(tests):
        action = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(action)
    fact = F.when(F.col("action") == "manual", F.col("manual_fact")).when(F.col("action") == "kept", F.col("current_fact")).when(F.col("action") == "same_url", F.col("url_fact")).when(F.col("action").isin("same_fact", "development"), F.col("_f"))
    return reports.join(v, F.col("id") == F.col("_q"), "left").withColumn("action", action).select("id", "action", fact.alias("fact"))


def grouping_in_order(reports: DataFrame, verdicts: DataFrame, facts: DataFrame) -> DataFrame:
    """id, action, fact, story for each report, as if they were decided one after another.

    reports: as of `grouping`, and place (their order; ids break ties). facts: fact, story, of the
    time before. A fact is named by the report that founded it. verdicts: query (a report's id),
    other (a report or a fact), action (same, url, development, roundup) and nth (which one counts
    first; others with the same nth go by other). A verdict counts if the other is a fact of the
    time before, or an earlier report that founded a fact: `same` and `url` join it, `development`
    founds a fact of its story, `roundup` stays without one. Where none counts, or a report is
    judged by itself only, `grouping` decides; a new story founds a fact.

    A report waits only for those earlier ones that could decide it. In each round all reports are
    decided whose first verdict not yet refuted is a fact, or that have none left, and verdicts on
    what founded no fact fall away; so rounds follow the longest chain of reports that depend on
    each other, and the frontier of undecided ones shrinks.
    """
    none = verdicts.limit(0).select("query", "action", F.col("other").alias("fact"))
    alone = grouping(reports.withColumn("url_fact", F.lit(None).cast(reports.schema["id"].dataType)), none)
    settled = alone.where("action <> 'new_story'").select("id", "action", "fact", F.lit(None).cast(reports.schema["id"].dataType).alias("story"))
    member = facts.select(F.col("fact").alias("_f"), F.col("story").alias("_s"))
    # A report put to a fact by hand, or kept there, is of that fact's story.
    done = checkpointed(settled.join(member, F.col("fact") == F.col("_f"), "left").select("id", "action", "fact", F.col("_s").alias("story")))
    order = reports.select("id", F.struct("place", "id").alias("_at"))
    open_ = alone.where("action = 'new_story'").select("id")
    founded = lambda rows, yes: rows.select(F.col("id").alias("other"), F.col("story").alias("_new"), yes.alias("_says"))
    edges = verdicts.select("query", "other", "action", "nth").join(open_, F.col("query") == F.col("id"), "left_semi").join(order.select(F.col("id").alias("query"), F.col("_at").alias("_q")), "query").join(order.select(F.col("id").alias("other"), F.col("_at").alias("_o")), "other", "left")
    edges = edges.join(member, F.col("other") == F.col("_f"), "left").where(F.col("_f").isNotNull() | (F.col("_o") < F.col("_q")))
    # _founded: whether the other is a fact, null as long as that is open; _story: of which story.
    edges = edges.select("query", "other", F.struct("nth", "other", "action").alias("_rank"), F.col("_s").alias("_story"), F.when(F.col("_f").isNotNull(), True).alias("_founded"))
    edges = edges.join(founded(done, F.lit(False)), "other", "left")
    undecided, results = checkpointed(open_), [done]
    while True:
        # Refuted verdicts fall away; told stay those that an answer came for in an earlier round.
        edges = edges.select("query", "other", "_rank", F.coalesce("_story", "_new").alias("_story"), F.coalesce("_founded", "_says").alias("_founded"))
        edges = checkpointed(edges.where(F.coalesce("_founded", F.lit(True))))
        first = edges.groupBy(F.col("query").alias("id")).agg(F.min(F.struct("_rank", F.coalesce("_founded", F.lit(False)).alias("sure"), "_story")).alias("_first"))
        now = undecided.join(first, "id", "left").where("_first is null or _first.sure")
        verdict = F.col("_first._rank.action")
        action = F.when(verdict == "same", "same_fact").when(verdict == "url", "same_url").otherwise(F.coalesce(verdict, F.lit("new_story")))
        fact = F.when(verdict.isin("same", "url"), F.col("_first._rank.other")).when(verdict.isNull() | (verdict == "development"), F.col("id"))
        story = F.when(verdict.isNull(), F.col("id")).when(verdict != "roundup", F.col("_first._story"))
        decided = checkpointed(now.select("id", action.alias("action"), fact.alias("fact"), story.alias("story")))
        results.append(decided)
        undecided = checkpointed(undecided.join(decided, "id", "left_anti"))
        if undecided.isEmpty():
            break
        edges = edges.join(undecided.select(F.col("id").alias("query")), "query", "left_semi").join(founded(decided, F.col("action").isin("new_story", "development")), "other", "left")
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


def signal_targets(signals: DataFrame, facts: DataFrame, links: DataFrame, similar: DataFrame) -> DataFrame:
    """post, fact, how of each discussion post that counts for a fact.

    signals: post, reference (a post it quotes), at. facts: member (post or report), fact, at.
    links: post, report it links to. similar: post, fact, score. The quoted post's fact comes first,
    then a linked report's of the last LINK_DAYS, then the most similar fact if that is sure; the
    next ones, up to SIGNAL_TOP, are to be judged and have `how` judge.
    """
    member = facts.select(F.col("member").alias("_m"), F.col("fact").alias("_fact"), F.col("at").alias("_at"))
    quoted = signals.join(member, F.col("reference") == F.col("_m")).groupBy("post").agg(F.min(F.struct("_at", "_fact"))["_fact"].alias("quoted"))
    linked = signals.join(links.select(F.col("post").alias("_p"), "report"), F.col("post") == F.col("_p")).join(member, (F.col("report") == F.col("_m")) & (F.col("_at") > F.col("at") - F.expr(f"INTERVAL {LINK_DAYS} DAYS")))
    linked = linked.groupBy("post").agg(F.min(F.struct("_at", "_fact"))["_fact"].alias("linked"))
    nth = F.row_number().over(Window.partitionBy("post").orderBy(F.col("score").desc(), "fact"))
    near = similar.where(F.col("score") >= JUDGED).withColumn("_n", nth).where(F.col("_n") <= SIGNAL_TOP)
    known = signals.select("post").join(quoted, "post", "left").join(linked, "post", "left").join(near, "post", "left")
    sure = F.coalesce("quoted", "linked")
    how = F.when(F.col("quoted").isNotNull(), "quoted").when(F.col("linked").isNotNull(), "linked").when((F.col("_n") == 1) & (F.col("score") >= AUTO), "similar").otherwise("judge")
    out = known.withColumn("how", how).withColumn("fact", F.coalesce(sure, "fact")).where(F.col("fact").isNotNull())
    best = F.min(F.when(F.col("how") == "similar", 1)).over(Window.partitionBy("post"))
    return out.withColumn("_sure", best).where((F.col("how") != "judge") | F.col("_sure").isNull()).select("post", "fact", "how").distinct()


def story_picks(rows: DataFrame, n: int) -> DataFrame:
    """story, heat, reports: stories with a fresh and an official report, the hottest n, each with
    its distinct reports in order. rows: story, report, heat, fresh, official; joins may repeat them."""
    per = rows.distinct().groupBy("story").agg(F.max(F.when(F.col("fresh"), F.col("heat"))).alias("heat"), F.bool_or("fresh").alias("_f"), F.bool_or("official").alias("_o"), F.sort_array(F.collect_set("report")).alias("reports"))
    return per.where("_f and _o").orderBy(F.col("heat").desc(), "story").limit(n).drop("_f", "_o")


def open_events(events: DataFrame, now: Column, n: int = 8) -> DataFrame:
    """kind, first_at, text: kinds with an event still open, each with its first one's text; the
    earliest n. events: kind, at, text, through, status."""
    still = (F.col("status") != "withdrawn") & (F.col("through").isNull() & (F.col("at") > now - F.expr("INTERVAL 24 HOURS")) | (F.col("through") > now))
    return events.where(still).groupBy("kind").agg(F.min("at").alias("first_at"), F.min_by("text", F.struct("at", "text")).alias("text")).orderBy("first_at", "kind").limit(n)


def owed(posts: DataFrame, targets: DataFrame, delivered: DataFrame) -> DataFrame:
    """post, target: what posts (post, kinds) owe to targets (target, kind) and was not delivered."""
    due = posts.select("post", F.explode("kinds").alias("kind")).join(targets, "kind").select("post", "target").distinct()
    return due.join(delivered, ["post", "target"], "left_anti")


def verified_mark(states: DataFrame) -> DataFrame:
    """source, mark: the newest mark where nothing is pending, else the one verified before.
    states: source, mark, verified, pending."""
    out = states.groupBy("source").agg(F.max("mark").alias("m"), F.max("verified").alias("v"), F.sum("pending").alias("p"))
    return out.select("source", F.when(F.col("p") == 0, F.col("m")).otherwise(F.col("v")).alias("mark"))


def most_engaging(posts: DataFrame, n: int) -> DataFrame:
    """query, post, points: the n posts of each query with the most likes + 2 reposts + replies."""
    points = (F.col("likes") + 2 * F.col("reposts") + F.col("replies")).cast("long")
    rows = posts.select("query", "post", points.alias("points"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("points").desc(), "post"))
    return rows.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")
