"""Heat, publishing, stories, reports, evaluation, consensus and monitor queries on the test tables.

Bindings: documents are articles, events are story signals (event_type the story, user_id the
participant, value the weight), conversations are monitored posts, part brands are models.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import consensus as C
from tidemark.operators import evaluation as E
from tidemark.operators import heat as H
from tidemark.operators import monitor as MO
from tidemark.operators import publish as P
from tidemark.operators import relational as R
from tidemark.operators import reports as RE
from tidemark.operators import stories as S
from tidemark.operators import usage as U
from tidemark.plans.registry import Registry
from tidemark.plans.relational import load, ts, unit_scores
from tidemark.session import checkpointed

REGISTRY = Registry()
add = REGISTRY.add
AT = "TIMESTAMP '2024-01-20 00:00:00'"


def at():
    return ts("2024-01-20 00:00:00")


# The publications that documents stand for, in Spark SQL and DuckDB alike.
PUB = """SELECT doc_id AS id, source, lang AS category, n_chars % 101 AS score, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS posted, doc_id % 4 <> 1 AS public,
n_chars % 101 >= 50 AS selected, doc_id % 11 = 0 AS backfill, doc_id % 5 = 0 AS first_party, CASE WHEN doc_id % 3 = 0 THEN CAST(floor(doc_id / 12) AS BIGINT) END AS story,
CASE WHEN doc_id % 3 < 2 THEN CAST(floor(doc_id / 4) AS BIGINT) END AS fact, substr(text, 1, 60) AS title, text FROM documents"""
PUB_SPARK = PUB.replace("doc_id * INTERVAL '1' HOUR", "make_dt_interval(0, CAST(doc_id AS INT))").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def publications(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = load(spark, d, "documents")
    return docs.selectExpr(*[c.strip() for c in _columns(PUB_SPARK)]).withColumnRenamed("posted", "at")


def _columns(sql: str) -> list[str]:
    """The select list of a plain SELECT, split posted commas outside brackets."""
    out, depth, start = [], 0, 0
    body = sql[len("SELECT ") : sql.index(" FROM documents")]
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
    return [*out, body[start:]]


def signals(spark: SparkSession, d: str) -> DataFrame:
    (e,) = load(spark, d, "events")
    return e.select(F.col("event_type").alias("story"), F.col("user_id").alias("participant"), F.col("ts").alias("seen"), (F.col("value") / 100).alias("weight"), (F.col("user_id") % 3 != 0).alias("editorial"), (F.col("user_id") % 7 == 0).alias("behind"))


SIGNALS = "SELECT event_type AS story, user_id AS participant, ts AS seen, value / 100 AS weight, user_id % 3 <> 0 AS editorial, user_id % 7 = 0 AS behind FROM events"


def heat_sql(at_sql: str, extra: str = "", source: str = f"({SIGNALS})") -> str:
    k, p = (f"{extra}, " if extra else ""), f"({at_sql} - INTERVAL 6 HOUR)"
    return f"""SELECT {k}story, count(l) AS participants, coalesce(sum(w * c), 0) AS heat, coalesce(sum(CASE WHEN lo > {p} - INTERVAL 168 HOUR THEN wo * co END), 0) AS heat_before,
coalesce(sum(CASE WHEN NOT b THEN w * c END), 0) AS heat_observed, coalesce(sum(CASE WHEN NOT bo AND lo > {p} - INTERVAL 168 HOUR THEN wo * co END), 0) AS heat_before_observed,
count(*) FILTER (WHERE b) AS behind_participants, count(*) FILTER (WHERE f > {p}) AS recent, count(*) FILTER (WHERE e) AS editorial_participants, count(*) FILTER (WHERE NOT e) AS signal_participants
FROM (SELECT *, pow(0.5, epoch({at_sql} - l) / 3600.0 / 72) AS c, pow(0.5, epoch({p} - lo) / 3600.0 / 72) AS co FROM
(SELECT {k}story, participant, max(seen) FILTER (WHERE seen > {at_sql} - INTERVAL 168 HOUR) AS l, min(seen) FILTER (WHERE seen > {at_sql} - INTERVAL 168 HOUR) AS f, max(seen) FILTER (WHERE seen <= {p}) AS lo,
bool_or(editorial) FILTER (WHERE seen > {at_sql} - INTERVAL 168 HOUR) AS e, bool_or(behind) FILTER (WHERE seen > {at_sql} - INTERVAL 168 HOUR) AS b, bool_or(behind) FILTER (WHERE seen <= {p}) AS bo,
max(weight) FILTER (WHERE seen > {at_sql} - INTERVAL 168 HOUR) AS w, max(weight) FILTER (WHERE seen <= {p}) AS wo FROM {source} WHERE seen > {p} - INTERVAL 168 HOUR AND seen <= {at_sql} GROUP BY {k}story, participant))
GROUP BY {k}story HAVING count(l) > 0"""


HEATS = ["heat", "heat_before", "heat_observed", "heat_before_observed"]
COUNTS = ["participants", "behind_participants", "recent", "editorial_participants", "signal_participants"]


def rounded(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def rounded_sql(sql: str, keys: str, digits: int = 4) -> str:
    return f"SELECT {keys}, {', '.join(f'round({n}, {digits}) AS {n}' for n in HEATS)}, {', '.join(COUNTS)} FROM ({sql})"


@add("c09_heat", rounded_sql(heat_sql(AT), "story"))
def c09(spark, d):
    return rounded(H.heat(signals(spark, d), at()), HEATS)


QUALITY_SQL = f"SELECT CASE id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' ELSE 'other' END AS story, max(score) AS s, bool_or(selected) AS sel FROM ({PUB}) WHERE public AND id % 40 < 30 GROUP BY 1"


def quality(spark, d):
    k = F.col("id") % 5
    story = F.when(k == 0, "view").when(k == 1, "click").when(k == 2, "error").when(k == 3, "purchase").otherwise("other")
    return publications(spark, d).where("public and id % 40 < 30").select(story.alias("story"), "score", "selected")


RANK_SQL = f"""SELECT h.story, round(heat * q, 3) AS heat, round(heat_before * q, 3) AS heat_before, participants, row_number() OVER (ORDER BY heat * q DESC, h.story) AS place FROM ({heat_sql(AT)}) h
LEFT JOIN ({QUALITY_SQL}) x ON x.story = h.story, LATERAL (SELECT coalesce(s / 100.0, 0.5) AS q) WHERE editorial_participants >= 1 AND (participants >= 2 OR coalesce(sel, false)) ORDER BY heat DESC LIMIT 10"""


@add("c11_hot_candidates", RANK_SQL)
def c11(spark, d):
    """The flagship: participants folded, decayed, weighted by quality, ranked."""
    from pyspark.sql import Window

    ranked = H.candidates(H.weighted(H.heat(signals(spark, d), at()), quality(spark, d)))
    top = ranked.orderBy(F.col("heat").desc(), "story").limit(10)
    place = F.row_number().over(Window.orderBy(F.col("heat").desc(), "story")).cast("long")
    return top.select("story", F.round("heat", 3).alias("heat"), F.round("heat_before", 3).alias("heat_before"), "participants", place.alias("place"))


@add("c11_trends", f"""SELECT story, floor(heat * 100 + 0.5) / 10 AS index, CASE WHEN floor(heat_before * 100 + 0.5) / 10 <= 0 THEN 'new' WHEN pct IS NULL THEN 'unknown' WHEN pct > 0.1 THEN 'up' WHEN pct < -0.1 THEN 'down' ELSE 'flat' END AS trend,
floor(pct * 1000 + 0.5) / 10 AS trend_pct, recent >= 3 AND recent / participants >= 0.5 AS surge FROM (SELECT *, CASE WHEN o > 0 THEN (n - o) / o END AS pct FROM (SELECT *, CASE WHEN behind_participants > 0 THEN floor(heat_observed * 100 + 0.5) / 10 ELSE floor(heat * 100 + 0.5) / 10 END AS n,
CASE WHEN behind_participants > 0 THEN floor(heat_before_observed * 100 + 0.5) / 10 ELSE floor(heat_before * 100 + 0.5) / 10 END AS o FROM ({heat_sql(AT)})))""")
def c11_trends(spark, d):
    rows = H.heat(signals(spark, d), at()).withColumn("first_report", at())
    return H.trends(rows, at(), "first_report").select("story", "index", "trend", "trend_pct", "surge")


@add("c10_behind_sources", f"SELECT user_id AS source FROM (SELECT user_id, max(ts) AS last_ok, 30 + user_id % 90 AS iv FROM events WHERE ts <= {AT} GROUP BY user_id) WHERE last_ok < {AT} - to_minutes(CAST(greatest(3 * iv, 90) AS BIGINT))")
def c10(spark, d):
    (e,) = load(spark, d, "events")
    clocks = e.where(F.col("ts") <= at()).groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("last_ok")).withColumn("interval_minutes", 30 + F.col("source") % 90)
    return H.behind_sources(clocks, at(), True)


@add("c12_combined_list")
def c12(spark, d):
    p = publications(spark, d)
    per = p.where("story is not null").groupBy("story").agg(F.sum("score").cast("double").alias("heat"), F.max("at").alias("latest"), F.min("source").alias("source"), (F.count_distinct("source") == 1).alias("single"), F.collect_set("category").alias("tracks"))
    return H.combined_list(per, ["en", "fr"])


@add("c13_hourly_heat", rounded_sql(heat_sql("hour", "hour", f"(SELECT s.*, hour FROM ({SIGNALS}) s CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-19 00:00:00', TIMESTAMP '2024-01-20 00:00:00', INTERVAL 6 HOUR)) AS hour))"), "story, hour"))
def c13(spark, d):
    hours = spark.range(1).select(F.explode(F.sequence(ts("2024-01-19 00:00:00"), ts("2024-01-20 00:00:00"), F.expr("INTERVAL 6 HOURS"))).alias("hour"))
    return rounded(H.hourly(signals(spark, d), hours), HEATS)


@add("c13_repair", """WITH s AS (SELECT user_id AS story, date_trunc('day', ts) AS hour, round(sum(value), 2) AS heat, count(*) % 2 = 0 AS complete FROM events GROUP BY ALL), n AS (SELECT user_id AS story, date_trunc('day', ts) AS hour, max(value) AS v FROM events WHERE user_id % 3 = 0 GROUP BY ALL)
SELECT s.story, s.hour, CASE WHEN NOT complete AND v IS NOT NULL THEN v ELSE heat END AS heat, complete OR v IS NOT NULL AS complete FROM s LEFT JOIN n ON s.story = n.story AND s.hour = n.hour""")
def c13_repair(spark, d):
    (e,) = load(spark, d, "events")
    keys = [F.col("user_id").alias("story"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("hour")]
    stored = e.groupBy(*keys).agg(F.round(F.sum("value"), 2).alias("heat"), (F.count("*") % 2 == 0).alias("complete"))
    return H.repair(stored, e.where("user_id % 3 = 0").groupBy(*keys).agg(F.max("value").alias("heat")))


@add("c25_sparkline", """SELECT event_type AS story, CAST(count(DISTINCT date_trunc('hour', ts)) AS BIGINT) AS filled, CAST(25 AS BIGINT) AS slots FROM events WHERE ts >= TIMESTAMP '2024-01-19 00:00:00' AND ts < TIMESTAMP '2024-01-20 01:00:00' GROUP BY 1""")
def c25_sparkline(spark, d):
    (e,) = load(spark, d, "events")
    hourly = e.groupBy(F.col("event_type").alias("story"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("value").alias("heat"))
    line = H.sparkline(hourly, at())
    return line.select("story", F.size(F.filter("points", lambda p: p.isNotNull())).cast("long").alias("filled"), F.size("points").cast("long").alias("slots"))


@add("c14_channel_pick", f"""WITH p AS ({PUB}), t AS (SELECT story, count(DISTINCT source) AS n FROM p WHERE story IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 2 AND bool_or(first_party)),
sel AS (SELECT DISTINCT story FROM p WHERE selected AND score > 90) SELECT DISTINCT ON (p.story) p.story, p.id, t.n AS participants FROM p JOIN t ON t.story = p.story WHERE p.story NOT IN (SELECT story FROM sel WHERE story IS NOT NULL) AND public AND score % 4 >= 2 ORDER BY p.story, score % 4 DESC, posted, p.id""")
def c14(spark, d):
    p = publications(spark, d).where("story is not null")
    enough = p.groupBy("story").agg(F.count_distinct("source").alias("participants"), F.bool_or("first_party").alias("b")).where("participants >= 2 and b")
    rows = p.where("public and score % 4 >= 2").join(enough, "story").join(p.where("selected and score > 90").select("story"), "story", "left_anti")
    return R.distinct_on(rows, ["story"], (F.col("score") % 4).desc(), F.col("at"), F.col("id")).select("story", "id", "participants")


# Materials and publishing

LISTING = """SELECT doc_id, source, doc_id % 300 AS identity, md5(substr(text, 1, 20)) AS hash, TIMESTAMP '2024-01-01' + doc_id * INTERVAL '1' HOUR AS discovered,
TIMESTAMP '2024-01-01' + (doc_id - doc_id % 90 + 3) * INTERVAL '1' HOUR AS claimed, CASE WHEN doc_id % 17 = 0 THEN 'import' END AS why FROM documents"""


def listings(spark, d):
    (docs,) = load(spark, d, "documents")
    spark_sql = LISTING.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("doc_id * INTERVAL '1' HOUR", "make_dt_interval(0, CAST(doc_id AS INT))").replace("(doc_id - doc_id % 90 + 3) * INTERVAL '1' HOUR", "make_dt_interval(0, CAST(doc_id - doc_id % 90 + 3 AS INT))")
    return docs.selectExpr(*_columns(spark_sql))


@add("c01_timeline_decision", f"""WITH l AS (SELECT *, CASE WHEN claimed <= discovered + INTERVAL 1 HOUR THEN claimed END AS published FROM ({LISTING})), r AS (SELECT *, coalesce(why, CASE WHEN discovered > published + INTERVAL 48 HOUR THEN 'stale-on-discovery' END) AS reason FROM l)
SELECT doc_id, published, CASE WHEN reason IS NOT NULL AND published IS NOT NULL THEN published ELSE discovered END AS timeline_at, reason IS NOT NULL AS backfill, reason, reason IS NOT NULL AND (published IS NULL OR discovered > published + INTERVAL 48 HOUR) AS historical FROM r""")
def c01(spark, d):
    rows = listings(spark, d).withColumn("t", P.timeline(F.col("claimed"), F.col("discovered"), F.col("why")))
    return rows.select("doc_id", "t.*", P.is_historical(F.col("t.backfill"), F.col("t.published"), F.col("discovered")).alias("historical"))


@add("c03_revisions", f"""WITH l AS ({LISTING}), o AS (SELECT identity, arg_min(source, (discovered, source)) AS owner FROM l GROUP BY 1), v AS (SELECT l.identity, hash, min(discovered) AS discovered FROM l JOIN o ON l.identity = o.identity AND l.source = o.owner GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY identity ORDER BY discovered, hash) AS revision FROM v""")
def c03(spark, d):
    return P.revisions(listings(spark, d))


@add("c03_versions")
def c03_versions(spark, d):
    """Turns of a conversation as listings of one material: by two sources, some without a body, some
    with a character lost, some that come back to an earlier text, a few imported."""
    (conv,) = load(spark, d, "conversations")
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    body = F.when(turn % 5 == 4, F.lit(None)).when(turn % 3 == 2, F.concat(F.substring(text, 1, 3), F.lit("\ufffd"), F.substr(text, F.lit(5), F.length(text)))).when(turn % 2 == 1, F.lit("the first text again")).otherwise(text)
    rows = conv.select(F.col("conv_id").cast("string").alias("identity"), F.when(turn % 4 == 3, "other").otherwise("own").alias("source"), (ts("2024-01-01") + F.make_interval(hours=turn.cast("int"))).alias("discovered"), F.lit("title").alias("title"), body.alias("body"), F.lit(None).cast("string").alias("excerpt"), (F.col("conv_id") % 3 == 0).alias("imported"))
    return P.versions(rows)


@add("c03_discoveries", f"SELECT identity, source, min(discovered) AS first_seen, count(*) AS times FROM ({LISTING}) GROUP BY 1, 2")
def c03_discoveries(spark, d):
    return P.discoveries(listings(spark, d))


@add("c04_identity_repair", f"""WITH p AS ({PUB}), k AS (SELECT id, first_value(id) OVER (PARTITION BY md5(lower(title)) ORDER BY selected DESC, length(text) DESC, posted, id) AS survivor FROM p)
SELECT survivor AS id, count(DISTINCT f) AS n_facts FROM (SELECT survivor, fact AS f FROM k JOIN p USING (id)) GROUP BY 1""")
def c04(spark, d):
    p = publications(spark, d)
    moved = P.repaired_identities(p, F.md5(F.lower("title")), [F.col("selected").desc(), F.length("text").desc(), F.col("at")])
    return P.rekeyed(p.select("id", "fact"), "id", moved).groupBy("id").agg(F.count_distinct("fact").alias("n_facts"))


@add("c05_projection", f"""WITH p AS ({PUB}), w AS (SELECT id, source, posted, CASE WHEN id % 9 = 0 THEN 'Set by hand' ELSE title END AS title, substr(text, 1, 30) AS summary, CAST(score AS DOUBLE) AS score, coalesce(CASE WHEN id % 13 = 0 THEN true END, id % 29 = 0) AS promotion,
CASE WHEN id % 23 = 0 THEN false ELSE selected END AS judged, fact, id % 6 <> 2 AS pass FROM p), e AS (SELECT *, pass AND source <> 'src3' AND length(title) > 0 AND length(summary) > 0 AND (source <> 'src4' OR score >= 20) AS eligible FROM w),
s AS (SELECT *, eligible AND judged AND source <> 'src5' AND NOT promotion AS selected FROM e), f AS (SELECT fact, min(posted) AS first_at FROM s WHERE eligible AND fact IS NOT NULL GROUP BY 1)
SELECT id, title, eligible, selected, promotion, CASE WHEN selected THEN CASE WHEN s.fact IS NOT NULL THEN posted ELSE posted + INTERVAL 180 SECOND END END AS visible_after, CASE WHEN selected THEN least(posted, first_at) ELSE posted END AS sort_at FROM s LEFT JOIN f ON s.fact = f.fact""")
def c05(spark, d):
    p = publications(spark, d)
    i = F.col("id")
    articles = p.select("id", "source", F.col("at").alias("timeline_at"), F.col("at").alias("discovered"), "title", F.lit(None).cast("long").alias("duplicate_of"))
    final = p.select("id", F.lit(2).alias("revision"), i.alias("analysis"), F.lit(None).cast("string").alias("title"), F.substring("text", 1, 30).alias("summary"), F.col("score").cast("double").alias("score"), F.when(i % 6 != 2, "pass").otherwise("block").alias("relevance"), "selected", (i % 29 == 0).alias("promotion"))
    older = final.withColumn("revision", F.lit(1)).withColumn("relevance", F.lit("block"))
    over = p.select("id", F.when(i % 9 == 0, "Set by hand").when(i % 2 == 0, " ").alias("title_set"), F.when(i % 23 == 0, False).alias("selected_set"), F.when(i % 13 == 0, True).alias("promotion_set"))
    src = p.select("source").distinct().select("source", F.when(F.col("source") == "src3", "hot_signal").otherwise("editorial").alias("mode"), F.when(F.col("source") == "src5", "EXCLUDE_MP").otherwise("T1").alias("tier"), F.when(F.col("source") == "src4", 20.0).alias("floor"))
    out = P.project(articles, older.unionByName(final), over, src, p.where("fact is not null").select("id", "fact"))
    return out.select("id", "title", "eligible", "selected", "promotion", "visible_after", "sort_at")


LEDGER = "SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS visible_at FROM events"


def ledger(spark, d):
    (e,) = load(spark, d, "events")
    entries = e.select("ts", "event_id", F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"), (F.col("ts") + F.make_interval(mins=F.floor("value").cast("int"))).alias("visible_at"))
    return R.append_ledger(entries, ["ts", "event_id"], 0)


MARK = f"(SELECT coalesce(min(seq) FILTER (WHERE visible_at > {AT}) - 1, max(seq), 0) FROM l)"


@add("k03_ledger_append", f"SELECT seq, key, op FROM ({LEDGER})")
def k03(spark, d):
    return ledger(spark, d).select("seq", "key", "op")


@add("c06_snapshot_diff", f"""WITH p AS ({PUB}), a AS (SELECT id, md5(title) AS h FROM p WHERE selected AND id % 7 <> 0), b AS (SELECT id, md5(CASE WHEN id % 10 = 0 THEN 'new' ELSE title END) AS h FROM p WHERE selected AND id % 7 <> 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'remove' ELSE 'upsert' END AS op FROM a FULL JOIN b ON a.id = b.id WHERE a.h IS DISTINCT FROM b.h""")
def c06(spark, d):
    p = publications(spark, d).where("selected")
    return R.changes(p.where("id % 7 <> 0"), p.where("id % 7 <> 1").withColumn("title", F.when(F.col("id") % 10 == 0, "new").otherwise(F.col("title"))), ["id"], ["title"])


@add("c07_watermark", f"WITH l AS ({LEDGER}) SELECT CAST({MARK} AS BIGINT) AS watermark")
def c07(spark, d):
    return P.watermark(ledger(spark, d), at())


@add("c08_snapshot", f"WITH l AS ({LEDGER}), x AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op FROM l WHERE seq <= {MARK} GROUP BY key) SELECT key, seq, op FROM x WHERE op = 'upsert' AND key % 5 <> 0")
def c08(spark, d):
    rows = ledger(spark, d)
    mark = P.watermark(rows, at())
    held = rows.crossJoin(F.broadcast(mark))
    keys = rows.select("key").where("key % 5 <> 0").distinct()
    return P.snapshot(held, F.col("watermark"), keys).select("key", "seq", "op")


@add("c08_changes", f"WITH l AS ({LEDGER}) SELECT seq, key, op FROM l WHERE seq > 500 AND seq <= {MARK} ORDER BY seq LIMIT 100")
def c08_changes(spark, d):
    rows = ledger(spark, d)
    held = rows.crossJoin(F.broadcast(P.watermark(rows, at())))
    return P.changes_after(held, 500, F.col("watermark"), 100).select("seq", "key", "op")


@add("k01_merge", """SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(b.v, a.v) AS v, CASE WHEN b.k IS NULL THEN 'kept' WHEN a.k IS NULL THEN 'inserted' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'updated' END AS action FROM
(SELECT o_custkey AS k, max(o_orderdate) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_orderdate) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) b ON a.k = b.k""")
def k01(spark, d):
    (o,) = load(spark, d, "orders")
    newest = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_orderdate").alias("v"))
    return R.merge(newest(o.where("o_orderstatus = 'F'")), newest(o.where("o_orderstatus <> 'P'")), ["o_custkey"], ["v"])


@add("k11_outbox", """SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events) d WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, event_type, max(value) AS v, count(*) AS n FROM events WHERE value > 20 GROUP BY ALL) s
WHERE s.user_id = d.user_id AND s.event_type = d.event_type AND (s.v > 95 OR s.n >= 5))""")
def k11(spark, d):
    (e,) = load(spark, d, "events")
    sent = e.where("value > 20").groupBy("user_id", "event_type").agg(F.when(F.max("value") > 95, "sent").otherwise("failed").alias("status"), F.count("*").alias("attempts"))
    return R.outbox(e.select("user_id", "event_type").distinct(), sent, ["user_id", "event_type"], 5)


DELIVERIES = "SELECT o_custkey AS id, year(o_orderdate) AS issue, CASE WHEN max(o_orderstatus) = 'F' THEN 'failed' ELSE 'sent' END AS status, count(*) AS attempts FROM orders GROUP BY 1, 2"


@add("e14_due_deliveries", f"""SELECT s.id FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'active' ELSE 'pending' END AS status FROM customer) s
LEFT JOIN ({DELIVERIES}) d ON d.id = s.id AND d.issue = 1994 WHERE s.status = 'active' AND (d.id IS NULL OR (d.status = 'failed' AND d.attempts < 3))""")
def e14(spark, d):
    c, o = load(spark, d, "customer", "orders")
    subscribers = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "active").otherwise("pending").alias("status"))
    status = F.when(F.max("o_orderstatus") == "F", "failed").otherwise("sent")
    deliveries = o.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("issue")).agg(status.alias("status"), F.count("*").alias("attempts"))
    return R.due_deliveries(subscribers, deliveries, 1994, 3).select("id")


# Filters


@add("f01_listed_pool", f"""SELECT id, public AND (NOT selected OR posted + INTERVAL 180 SECOND <= {AT}) AS listed, public AND (NOT selected OR posted + INTERVAL 180 SECOND <= {AT}) AND score >= 20 AND id % 29 <> 0 AS exported, category IN ('en', 'fr') AS in_category, posted >= {AT} - INTERVAL 7 DAY AND posted <= {AT} AS in_week FROM ({PUB})""")
def f01(spark, d):
    p = publications(spark, d)
    vis = F.col("at") + F.expr("INTERVAL 180 SECONDS")
    listed = P.listed(F.when(F.col("public"), "public").otherwise("withdrawn"), F.col("selected"), vis, at())
    return p.select("id", listed.alias("listed"), (listed & (F.col("score") >= 20) & (F.col("id") % 29 != 0)).alias("exported"), F.col("category").isin("en", "fr").alias("in_category"), F.col("at").between(at() - F.expr("INTERVAL 7 DAYS"), at()).alias("in_week"))


@add("f07_tags_overlap", r"""SELECT doc_id, list_contains(w, 'the') AS tagged, list_has_any(w, ['der', 'que']) AS overlaps FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""")
def f07(spark, d):
    (docs,) = load(spark, d, "documents")
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return docs.select("doc_id", F.array_contains(w, "the").alias("tagged"), F.arrays_overlap(w, F.lit(["der", "que"])).alias("overlaps"))


@add("f14_noise_reason", r"""SELECT doc_id, CASE WHEN lang = 'es' THEN 'denyCategory:es' WHEN NOT contains(h, 'the') THEN 'requireMarkers' WHEN contains(h, 'license') THEN NULL WHEN contains(t, 'ation') THEN 'dropMarkersTitleOnly' WHEN contains(h, 'stupid') THEN 'dropMarkers' END AS reason FROM (SELECT doc_id, lang, lower(left(text, 60)) AS t, lower(text) AS h FROM documents)""")
def f14(spark, d):
    from tidemark.sources.listing import noise_reason

    (docs,) = load(spark, d, "documents")
    rules = {"deny": ["es"], "allow": [], "require": ["the"], "keep": ["license"], "drop_title": ["ation"], "drop": ["stupid"]}
    return docs.select("doc_id", noise_reason(F.substring("text", 1, 60), F.col("text"), F.array("lang"), rules).alias("reason"))


# Search, timeline, topics, stories


@add("c23_pool_search", r"""SELECT doc_id, rel FROM (SELECT doc_id, n_chars, sum(3 * contains(lower(left(text, 200)), t)::INT + contains(lower(text), t)::INT + 6 * contains(lower(left(text, 60)), t)::INT) AS rel, bool_and(contains(lower(text), t)) AS every FROM documents, (SELECT unnest(['the', 'ation']) AS t) GROUP BY ALL) WHERE every ORDER BY rel DESC, n_chars DESC, doc_id DESC LIMIT 40""".replace("SELECT doc_id, rel FROM", "SELECT doc_id, CAST(rel AS INTEGER) AS rel FROM"))
def c23(spark, d):
    (docs,) = load(spark, d, "documents")
    low = docs.select("doc_id", "n_chars", F.lower("text").alias("body"), F.lower(F.substring("text", 1, 200)).alias("direct"), F.substring("text", 1, 60).alias("title"))
    found = S.relevance(low, S.search_terms("The ation"), F.col("direct"), F.col("body"), F.col("title"))
    return R.offset_page(found.select("doc_id", "n_chars", "rel"), [F.col("rel").desc(), F.col("n_chars").desc(), F.col("doc_id").desc()], 1).select("doc_id", "rel")


GK = "coalesce('s' || story, 'f' || fact, 'a' || id)"


@add("c21_timeline_fold", f"""WITH p AS (SELECT *, {GK} AS gk FROM ({PUB}) WHERE selected AND public), g AS (SELECT gk, max(posted) AS anchor FROM p GROUP BY 1 HAVING (max(posted), gk) < ({AT}, 's9') ORDER BY anchor DESC, gk DESC LIMIT 21)
SELECT gk, anchor, count(*) AS reports, count(DISTINCT fact) AS facts, count(DISTINCT source) AS sources, arg_min(id, (NOT first_party, -score, posted, id)) AS representative FROM p JOIN g USING (gk) GROUP BY 1, 2""")
def c21(spark, d):
    items = publications(spark, d).where("selected and public").withColumnRenamed("at", "sort_at")
    return S.timeline_fold(items, (datetime.datetime(2024, 1, 20), "s9"), 20)


@add("c22_developments", f"""SELECT story, fact, count(*) AS reports, max(posted) AS latest, row_number() OVER (PARTITION BY story ORDER BY max(posted) DESC, fact) AS place FROM ({PUB}) WHERE story IS NOT NULL AND fact IS NOT NULL GROUP BY 1, 2""")
def c22(spark, d):
    from pyspark.sql import Window

    p = publications(spark, d).where("story is not null and fact is not null").groupBy("story", "fact").agg(F.count("*").alias("reports"), F.max("at").alias("latest"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("story").orderBy(F.col("latest").desc(), "fact")).cast("long"))


@add("c24_topic_counts", rf"""WITH i AS (SELECT id, posted, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS tags FROM ({PUB}) WHERE selected), t AS (SELECT * FROM (VALUES ('articles', ['the', 'der', 'la']), ('genitive', ['of', 'de', 'des']), ('none', ['zzz'])) v(slug, tags))
SELECT slug, count(id) AS total, count(id) FILTER (WHERE posted > {AT} - INTERVAL 30 DAY) AS recent, max(posted) AS latest, count(id) >= 50 OR count(id) >= 20 AND count(id) FILTER (WHERE posted > {AT} - INTERVAL 30 DAY) > 0 AS indexable FROM t LEFT JOIN i ON list_has_any(i.tags, t.tags) GROUP BY slug""")
def c24(spark, d):
    tags = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    items = publications(spark, d).where("selected").select("id", "at", tags.alias("tags"))
    topics = spark.createDataFrame([("articles", ["the", "der", "la"]), ("genitive", ["of", "de", "des"]), ("none", ["zzz"])], "slug string, tags array<string>")
    return S.topic_counts(items, topics, at())


@add("c25_story_page", f"""SELECT story, count(DISTINCT id) AS reports, count(DISTINCT fact) AS developments, count(*) FILTER (WHERE first_party) AS first_party, min(posted) AS first_report, max(posted) AS latest, CASE WHEN epoch({AT} - max(posted)) < 86400 THEN 'active' WHEN epoch({AT} - max(posted)) < 259200 THEN 'watching' ELSE 'settled' END AS status FROM ({PUB}) WHERE story IS NOT NULL AND public GROUP BY 1""")
def c25(spark, d):
    from tidemark.functions.dates import story_status

    p = publications(spark, d).where("story is not null and public")
    page = p.groupBy("story").agg(F.count_distinct("id").alias("reports"), F.count_distinct("fact").alias("developments"), F.count_if("first_party").alias("first_party"), F.min("at").alias("first_report"), F.max("at").alias("latest"))
    return page.withColumn("status", story_status(F.col("latest"), at()))


@add("c15_recall", """WITH e AS (SELECT vec_id, label, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(vec_id % 700 AS BIGINT)) AS posted, embedding::DOUBLE[] AS v, vec_id % 7 <> 3 AS known, 'report of ' || label || ' no ' || vec_id AS title FROM embeddings),
g AS (SELECT DISTINCT vec_id, t[i:i+1] AS p FROM (SELECT vec_id, t, unnest(range(1, length(t))) AS i FROM (SELECT vec_id, replace(title, ' ', '') AS t FROM e))), n AS (SELECT vec_id, count(*) AS n FROM g GROUP BY 1),
m AS (SELECT q.vec_id AS query, e.vec_id AS report, e.label AS fact, q.known AND e.known AS both_known, q.v AS qv, e.v AS ev FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id AND e.posted BETWEEN q.posted - INTERVAL 14 DAY AND q.posted),
c AS (SELECT query, report, fact, list_cosine_similarity(ev, qv) AS score FROM m WHERE both_known UNION ALL
SELECT m.query, m.report, m.fact, 1.0 * count(y.p) / least(any_value(a.n), any_value(b.n)) FROM m JOIN n a ON a.vec_id = m.query JOIN n b ON b.vec_id = m.report JOIN g x ON x.vec_id = m.query LEFT JOIN g y ON y.vec_id = m.report AND y.p = x.p WHERE NOT both_known GROUP BY 1, 2, 3),
b AS (SELECT query, fact, max(score) AS score FROM (SELECT c.*, both_known FROM c JOIN m USING (query, report, fact)) WHERE score >= CASE WHEN both_known THEN 0.2 ELSE 0.25 END GROUP BY ALL)
SELECT query, fact, round(score, 5) AS score, nth FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, fact) AS nth FROM b) WHERE nth <= 10""")
def c15(spark, d):
    (e,) = load(spark, d, "embeddings")
    title = F.concat(F.lit("report of "), F.col("label").cast("string"), F.lit(" no "), F.col("vec_id").cast("string"))
    posted = ts("2024-01-01 00:00:00") + F.make_interval(hours=(F.col("vec_id") % 700).cast("int"))
    rows = e.select(F.col("vec_id").alias("report"), F.col("label").alias("fact"), posted.alias("at"), title.alias("title"), F.when(F.col("vec_id") % 7 != 3, F.col("embedding")).alias("vector"))
    queries = rows.where("report % 20 = 0").select(F.col("report").alias("query"), "at", "title", "vector")
    return S.recall(queries, rows, 0.2).withColumn("score", F.round("score", 5))


VERDICTS = "SELECT o_custkey AS query, o_orderkey AS fact, o_orderkey % 2 = 0 AS story_root, CASE o_orderkey % 4 WHEN 0 THEN 'SAME_STORY' WHEN 1 THEN 'ROUNDUP' WHEN 2 THEN 'UNRELATED' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'SAME_OCCURRENCE' ELSE 'ROUNDUP' END END AS relation, o_totalprice % 100 / 100 AS confidence, o_totalprice AS score FROM orders"


def verdicts(spark, d):
    (o,) = load(spark, d, "orders")
    k = F.col("o_orderkey")
    relation = F.when(k % 4 == 0, "SAME_STORY").when(k % 4 == 1, "ROUNDUP").when(k % 4 == 2, "UNRELATED").when(k % 5 == 0, "SAME_OCCURRENCE").otherwise("ROUNDUP")
    return o.select(F.col("o_custkey").alias("query"), k.alias("fact"), (k % 2 == 0).alias("story_root"), relation.alias("relation"), (F.col("o_totalprice") % 100 / 100).alias("confidence"), F.col("o_totalprice").alias("score"))


@add("c16_relation_rules", f"""WITH v AS ({VERDICTS}), a AS (SELECT query, arg_min(fact, (-confidence, -score, fact)) FILTER (WHERE relation = 'SAME_OCCURRENCE') AS s, arg_min(fact, (-score, fact)) FILTER (WHERE relation = 'SAME_STORY' AND story_root) AS dv, arg_min(fact, (-score, fact)) FILTER (WHERE relation = 'SAME_STORY' AND confidence >= 0.8) AS re, bool_and(relation = 'ROUNDUP') AS ro FROM v GROUP BY 1)
SELECT query, CASE WHEN s IS NOT NULL THEN 'same' WHEN dv IS NOT NULL THEN 'development' WHEN ro THEN 'roundup' ELSE 'new' END AS action, coalesce(s, dv) AS fact, coalesce(s, re) AS signal FROM a""")
def c16(spark, d):
    return S.decide(verdicts(spark, d))


@add("c19_merge_roots", """WITH RECURSIVE e AS (SELECT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08 AND l_suppkey <> l_partkey % 100), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS s, a AS t FROM u UNION SELECT r.s, u.b FROM r JOIN u ON r.t = u.a) SELECT s AS story, arg_min(t, (t * 7 % 11, t)) AS root FROM r GROUP BY s""")
def c19(spark, d):
    (li,) = load(spark, d, "lineitem")
    pairs = li.where("l_quantity = 50 and l_discount > 0.08 and l_suppkey <> l_partkey % 100").select(F.col("l_suppkey").alias("story"), (F.col("l_partkey") % 100).alias("other"))
    ids = pairs.select("story").union(pairs.select("other")).distinct()
    return S.merge_into_roots(pairs, ids.select("story", (F.col("story") * 7 % 11).alias("first_at")))


@add("c20_related", """WITH t AS (SELECT l_orderkey AS r, l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_quantity > 40 AND l_suppkey <> l_partkey % 100), p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(DISTINCT r) AS reports FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 2) SELECT a AS story, b AS other, reports FROM p UNION ALL SELECT b, a, reports FROM p""")
def c20(spark, d):
    (li,) = load(spark, d, "lineitem")
    ties = li.where("l_quantity > 40").select(F.col("l_orderkey").alias("report"), F.col("l_suppkey").alias("story"), (F.col("l_partkey") % 100).alias("other"))
    return S.related(ties)


@add("c44_screening", f"""WITH f AS (SELECT story, source AS participant, id, posted, score AS rank FROM ({PUB}) WHERE story IS NOT NULL AND posted BETWEEN {AT} - INTERVAL 7 DAY AND {AT} + INTERVAL 7 DAY AND NOT regexp_matches(source, '^src1$') AND score / 101 >= 0.3), c AS (SELECT story, source FROM ({PUB}) WHERE first_party AND story IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY story, participant ORDER BY rank, id) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.story = f.story AND c.source = f.participant)) SELECT story, participant, id, row_number() OVER (PARTITION BY story ORDER BY rank, participant, id) AS place FROM b WHERE n = 1 QUALIFY place <= 10""")
def c44(spark, d):
    p = publications(spark, d).where("story is not null")
    found = p.select("story", F.col("source").alias("participant"), F.col("source").alias("host"), "id", "at", F.col("score").alias("rank"))
    counted = p.where("first_party").select("story", F.col("source").alias("participant"))
    return S.screened(found, at(), "^src1$", counted, F.col("rank") / 101).select("story", "participant", "id", "place")


@add("t20_keep_first_texts")
def t20(spark, d):
    (docs,) = load(spark, d, "documents")
    pages = docs.select((F.col("doc_id") % 50).alias("group"), F.col("doc_id").alias("place"), "text")
    return S.keep_first_texts(pages, T.word_runs(F.col("text")), text=F.col("text")).select("group", "place")


# Reports

ITEMS = f"SELECT *, posted + to_minutes(CAST(score AS BIGINT)) AS visible_after, category AS track, source AS section FROM ({PUB})"


def items(spark, d):
    return publications(spark, d).withColumn("visible_after", F.col("at") + F.make_interval(mins=F.col("score").cast("int"))).withColumn("track", F.col("category")).withColumn("section", F.col("source"))


MEMBERS = f"SELECT *, coalesce('f:' || fact, 'a:' || id) AS fact_key FROM ({ITEMS}) WHERE public AND selected AND NOT backfill AND greatest(visible_after, posted) >= TIMESTAMP '2024-01-02' AND greatest(visible_after, posted) < TIMESTAMP '2024-02-20'"


def members(spark, d):
    return RE.one_per_fact(RE.members(items(spark, d), ts("2024-01-02"), ts("2024-02-20")))


@add("c26_report_candidates", f"SELECT DISTINCT ON (fact_key) fact_key, id FROM ({MEMBERS}) ORDER BY fact_key, first_party DESC, score DESC NULLS LAST, id")
def c26(spark, d):
    return members(spark, d).select("fact_key", "id")


@add("c27_compose_daily", f"""WITH m AS (SELECT DISTINCT ON (fact_key) * FROM ({MEMBERS}) ORDER BY fact_key, first_party DESC, score DESC NULLS LAST, id), h AS (SELECT DISTINCT fact_key FROM ({MEMBERS}) WHERE id % 10 = 0), c AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, id) AS n FROM m WHERE fact_key NOT IN (SELECT fact_key FROM h))
SELECT id, track, 'section' AS slot, n AS place FROM c WHERE n <= 8 UNION ALL SELECT id, track, 'flash', n - 8 FROM c WHERE n > 8 AND n <= 20""")
def c27(spark, d):
    rows = members(spark, d).withColumn("section", F.lit("all"))
    history = RE.members(items(spark, d), ts("2024-01-02"), ts("2024-02-20")).where("id % 10 = 0")
    keys = F.coalesce(F.concat(F.lit("f:"), F.col("fact").cast("string")), F.concat(F.lit("a:"), F.col("id").cast("string")))
    past = history.groupBy(F.lit("2024-02-18").cast("date").alias("day")).agg(F.collect_set(keys).alias("fact_keys"))
    return RE.compose(RE.fresh(rows, past, F.lit("2024-02-20").cast("date"))).select("id", "track", "slot", "place")


@add("c28_catch_up", "SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20', INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE value > 99.5)")
def c28(spark, d):
    (e,) = load(spark, d, "events")
    stored = e.where("value > 99.5").select(F.to_date("ts").alias("day")).distinct()
    return RE.due(F.lit("2024-01-05").cast("date"), at(), stored, spark)


@add("c29_report_read", f"""WITH e AS (SELECT id % 20 AS report, id, score AS place FROM ({PUB}) WHERE selected) SELECT report, e.id, place, coalesce(p.public, false) AS available, coalesce(nullif(p.title, ''), '(withdrawn)') AS headline, lag(report) OVER (ORDER BY report, e.id) IS DISTINCT FROM report AS first_row FROM e LEFT JOIN (SELECT * FROM ({PUB}) WHERE id % 3 > 0) p ON p.id = e.id""")
def c29(spark, d):
    from pyspark.sql import Window

    p = publications(spark, d)
    entries = p.where("selected").select((F.col("id") % 20).alias("report"), "id", F.col("score").alias("place"))
    out = RE.read(entries, p.where("id % 3 > 0"))
    first = F.lag("report").over(Window.partitionBy("report").orderBy("id")).isNull()
    return out.select("report", "id", "place", "available", "headline", first.alias("first_row"))


# Operations


@add("c30_rhythm", f"""WITH s AS (SELECT DISTINCT user_id AS source, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events WHERE value > 60 AND ts > {AT} - INTERVAL 90 DAY AND ts <= {AT}), g AS (SELECT *, day - lag(day) OVER (PARTITION BY source ORDER BY day) AS gap FROM s),
r AS (SELECT source, count(*) AS days, quantile_cont(gap, 0.5) AS median_gap, CAST(CAST({AT} + INTERVAL 8 HOUR AS DATE) - max(day) AS BIGINT) AS quiet_days FROM g GROUP BY 1) SELECT *, round(quiet_days / median_gap, 4) AS quiet_multiple, coalesce(days >= 4 AND quiet_days > 5 * median_gap, false) AS overdue FROM r""")
def c30(spark, d):
    (e,) = load(spark, d, "events")
    return U.rhythm(e.where("value > 60").withColumnRenamed("user_id", "source"), "source", "ts", at())


@add("c41_usage", """SELECT event_type, user_id % 5 AS model, count(*) AS calls, count(*) FILTER (WHERE value <= 80) AS ok, count(*) FILTER (WHERE NOT value <= 80) AS failed, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(sum(value * 0.042), 4) AS cost FROM events GROUP BY 1, 2""")
def c41(spark, d):
    (e,) = load(spark, d, "events")
    return U.usage(e.withColumn("model", F.col("user_id") % 5), ["event_type", "model"], "value", F.col("value") <= 80, F.col("value") * 0.042)


@add("c42_alerts", """WITH c AS (SELECT user_id, count(*) AS n, max(value) AS m, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1), f AS (SELECT user_id, 'errors' AS rule, 'high' AS severity FROM c WHERE e >= 18 UNION ALL SELECT user_id, 'quiet', 'low' FROM c WHERE n < 60 UNION ALL SELECT user_id, 'peak', 'low' FROM c WHERE m > 99.9),
o AS (SELECT DISTINCT user_id, 'errors' AS rule FROM events WHERE user_id % 4 = 0) SELECT coalesce(f.user_id, o.user_id) AS user_id, coalesce(f.rule, o.rule) AS rule, severity, CASE WHEN severity IS NULL THEN 'recovered' WHEN o.rule IS NOT NULL THEN 'repeated' ELSE 'new' END AS state FROM f FULL JOIN o ON f.user_id = o.user_id AND f.rule = o.rule""")
def c42(spark, d):
    (e,) = load(spark, d, "events")
    counts = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("m"), F.count_if(F.col("event_type") == "error").alias("e"))
    rules = [("errors", "high", F.col("e") >= 18), ("quiet", "low", F.col("n") < 60), ("peak", "low", F.col("m") > 99.9)]
    return U.alerts(counts, rules, "user_id", e.where("user_id % 4 = 0").select("user_id", F.lit("errors").alias("rule")).distinct())


@add("c43_retention", f"SELECT event_id FROM events WHERE ts >= {AT} - INTERVAL 7 DAY")
def c43(spark, d):
    (e,) = load(spark, d, "events")
    return U.retained(e, "ts", at(), 7).select("event_id")


@add("c45_lookup_buckets", """WITH b AS (SELECT event_type, user_id, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS bucket, bool_or(value > 90) AS productive FROM events WHERE value > 50 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY bucket) AS n, lag(productive) OVER (PARTITION BY event_type, user_id ORDER BY bucket) AS before FROM b) SELECT event_type, user_id, bucket FROM r WHERE n = 1 OR n = 2 AND before""")
def c45(spark, d):
    from pyspark.sql import Window

    (e,) = load(spark, d, "events")
    buckets = e.where("value > 50").groupBy("event_type", "user_id", F.floor(F.timestamp_diff("SECOND", ts("1970-01-01"), F.col("ts")) / 43200).alias("bucket")).agg(F.bool_or(F.col("value") > 90).alias("productive"))
    w = Window.partitionBy("event_type", "user_id").orderBy("bucket")
    return buckets.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("productive").over(w)).where("n = 1 or n = 2 and before").select("event_type", "user_id", "bucket")


@add("c47_retry_schedule", """SELECT doc_id, TIMESTAMP '2024-01-01' + to_hours(CAST([6, 24, 72, 168, 336][tries + 1] AS BIGINT)) AS next_try FROM (SELECT doc_id, doc_id % 6 AS tries FROM documents)""")
def c47(spark, d):
    (docs,) = load(spark, d, "documents")
    tries = (F.col("doc_id") % 6).cast("int")
    wait = F.get(F.lit([6, 24, 72, 168, 336]), tries)
    return docs.select("doc_id", (ts("2024-01-01") + F.make_interval(hours=wait)).alias("next_try"))


@add("c49_selection_judgement", f"""SELECT id, CASE WHEN id % 6 = 2 THEN 'block' WHEN title = '' THEN 'unknown' ELSE 'pass' END AS relevance, id % 6 <> 2 AND title <> '' AND score >= CASE category WHEN 'en' THEN 60 WHEN 'fr' THEN 65 ELSE 76 END AND id % 29 <> 0 AS selected FROM ({PUB})""")
def c49(spark, d):
    p = publications(spark, d)
    from tidemark.functions.math import threshold

    relevance = F.when(F.col("id") % 6 == 2, "block").when(F.col("title") == "", "unknown").otherwise("pass")
    tier = F.when(F.col("category") == "en", "T1").when(F.col("category") == "fr", "T1_5").otherwise("T2")
    return p.select("id", relevance.alias("relevance"), ((relevance == "pass") & (F.col("score") >= threshold(tier, F.lit("industry"))) & (F.col("id") % 29 != 0)).alias("selected"))


# Evaluation

GOLD = "SELECT l.doc_id, quality AS gold, CASE WHEN n_chars % 7 < 4 THEN 1 ELSE 0 END AS predicted, n_chars % 101 AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality IS NOT NULL"


def gold(spark, d):
    labels, docs = load(spark, d, "labels", "documents")
    rows = labels.where("quality is not null").join(docs, "doc_id")
    return rows.select("doc_id", F.col("quality").alias("gold"), F.when(F.col("n_chars") % 7 < 4, 1).otherwise(0).alias("predicted"), (F.col("n_chars") % 101).alias("score"))


@add("g20_confusion", f"SELECT gold, predicted, count(*) AS n FROM ({GOLD}) GROUP BY 1, 2")
def g20(spark, d):
    return E.confusion(gold(spark, d), "gold", "predicted")


@add("g20_per_class", f"""WITH m AS (SELECT gold, predicted, count(*) AS n FROM ({GOLD}) GROUP BY 1, 2), c AS (SELECT DISTINCT gold AS class FROM m), s AS (SELECT class, (SELECT sum(n) FROM m WHERE gold = class AND predicted = class) AS tp, (SELECT sum(n) FROM m WHERE gold = class) AS support, (SELECT sum(n) FROM m WHERE predicted = class) AS named FROM c)
SELECT class, round(tp / greatest(1, named), 3) AS precision, round(tp / greatest(1, support), 3) AS recall, round(2 * (tp / greatest(1, named)) * (tp / greatest(1, support)) / greatest(1e-9, tp / greatest(1, named) + tp / greatest(1, support)), 3) AS f1, CAST(support AS BIGINT) AS support FROM s""")
def g20_per_class(spark, d):
    return E.per_class(E.confusion(gold(spark, d), "gold", "predicted"))


@add("g21_threshold_sweep", f"""WITH t AS (SELECT CAST(unnest(generate_series(40, 90, 2)) AS INTEGER) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND gold = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND gold <> 1) AS fp, count(*) FILTER (WHERE score < threshold AND gold = 1) AS fn, count(*) FILTER (WHERE score < threshold AND gold <> 1) AS tn FROM ({GOLD}), t GROUP BY 1)
SELECT *, round(tp / greatest(1, tp + fp), 3) AS precision, round(tp / greatest(1, tp + fn), 3) AS recall, round(2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-9, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 3) AS f1 FROM c""")
def g21(spark, d):
    return E.sweep(gold(spark, d), F.col("score"), F.col("gold") == 1, list(range(40, 91, 2)))


@add("c39_label_queue", f"""WITH r AS (SELECT id, score, 60 AS t, id % 29 = 0 AS promo, CASE WHEN id % 6 = 2 THEN 'block' ELSE 'pass' END AS rel FROM ({PUB}) WHERE id NOT IN (SELECT doc_id FROM labels)), q AS (SELECT id, CASE WHEN promo THEN 'promotion' WHEN rel = 'block' THEN 'blocked' WHEN abs(score - t) <= 5 THEN 'near_threshold' END AS queue FROM r)
SELECT id, queue FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY md5(CAST(id AS VARCHAR))) AS n FROM q WHERE queue IS NOT NULL) WHERE n <= 10""")
def c39(spark, d):
    (labels,) = load(spark, d, "labels")
    rows = publications(spark, d).select("id", "score", F.lit(60).alias("threshold"), (F.col("id") % 29 == 0).alias("promotion"), F.when(F.col("id") % 6 == 2, "block").otherwise("pass").alias("relevance"))
    return E.label_queue(rows, labels.select(F.col("doc_id").alias("id")))


@add("c39_role_sample")
def c39_roles(spark, d):
    rows = publications(spark, d).select("id", F.col("score").cast("double").alias("score"), F.lit(60.0).alias("threshold"), F.array_distinct(F.array("category", F.when(F.col("id") % 3 == 0, "es").otherwise("de"))).alias("roles"), (F.col("id") % 50 == 0).alias("picked"))
    return E.role_sample(rows, ["en", "fr", "de", "es"], 100)


@add("c40_bench_compare", """SELECT user_id AS case, max(event_type) FILTER (WHERE m = 0) AS m0, max(event_type) FILTER (WHERE m = 1) AS m1, count(DISTINCT event_type) > 1 AS disagree FROM (SELECT user_id, m, min(event_type) AS event_type FROM (SELECT *, event_id % 2 AS m FROM events WHERE event_id % 2 < 2) GROUP BY 1, 2) GROUP BY 1""")
def c40(spark, d):
    (e,) = load(spark, d, "events")
    model = F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string"))
    results = e.groupBy(F.col("user_id").alias("case"), model.alias("model")).agg(F.min("event_type").alias("outcome"))
    return E.bench_compare(results, ["m0", "m1"])


# Consensus

UNITS = "SELECT p_brand AS model, l_suppkey % 8 AS unit, avg(l_extendedprice) AS score, 1.0 AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


@add("c31_representatives", """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'ineligible' WHEN row_number() OVER (PARTITION BY p_brand, p_size % 10 = 0 ORDER BY p_size DESC, length(p_name), p_partkey) = 1 THEN 'representative' ELSE 'other configuration' END AS reason FROM part""")
def c31(spark, d):
    (p,) = load(spark, d, "part")
    out = C.representatives(p, ["p_brand"], [F.col("p_size").desc(), F.length("p_name"), F.col("p_partkey")], F.col("p_size") % 10 == 0)
    return out.select("p_partkey", "reason")


@add("c32_qualified", f"SELECT model, count(DISTINCT unit) AS n_unit, count(DISTINCT unit % 3) AS n_family FROM ({UNITS}) WHERE score > 30000 GROUP BY 1 HAVING count(DISTINCT unit) >= 2 AND count(DISTINCT unit % 3) >= 2")
def c32(spark, d):
    rows = unit_scores(spark, d).withColumn("family", F.col("unit") % 3)
    return C.qualified(rows, [("unit", 2), ("family", 2)], F.col("score") > 30000)


BOARDS = "SELECT l_linenumber AS board, p_brand AS model, l_suppkey % 8 AS unit, l_suppkey % 8 % 3 AS operator, 1.0 + l_suppkey % 8 % 2 AS weight, avg(l_extendedprice) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5"


def board_scores(spark, d):
    """A board for each line number: brands as models, groups of suppliers as units, each with
    an operator and a weight, and mean prices with their errors as scores."""
    li, p = load(spark, d, "lineitem", "part")
    unit = F.col("l_suppkey") % 8
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_linenumber").alias("board"), F.col("p_brand").alias("model"), unit.alias("unit"))
    error = F.coalesce(F.stddev("l_extendedprice") / F.sqrt(F.count("*")), F.lit(0.0))
    return rows.agg(F.avg("l_extendedprice").alias("score"), error.alias("error")).withColumn("operator", F.col("unit") % 3).withColumn("weight", 1.0 + F.col("unit") % 2)


@add("c33_consensus_order")
def c33(spark, d):
    return C.consensus(C.net_support(board_scores(spark, d), by=["board"]), "board", ["Brand#11", "Brand#33"])


VARIANTS = f"""WITH u AS ({BOARDS}), v AS (SELECT DISTINCT board, 'without operator ' || operator AS variant, unit, -1.0 AS factor FROM u UNION ALL SELECT DISTINCT board, 'without unit ' || unit, unit, -1.0 FROM u UNION ALL SELECT DISTINCT board, 'less ' || unit, unit, -0.2 FROM u UNION ALL SELECT DISTINCT board, 'more ' || unit, unit, 0.2 FROM u),
p AS (SELECT x.board, x.unit, x.model AS a, y.model AS b, sign(x.score - y.score) * x.weight AS s FROM u x JOIN u y ON x.board = y.board AND x.unit = y.unit AND x.model < y.model)
SELECT p.board, n.variant, a, b, CASE WHEN count(*) > count(*) FILTER (v.factor = -1) THEN CAST(sum(s * (1 + coalesce(v.factor, 0))) AS DOUBLE) ELSE 0 END AS net, count(*) - count(*) FILTER (v.factor = -1) AS shared FROM p JOIN (SELECT DISTINCT board, variant FROM v) n ON n.board = p.board LEFT JOIN v ON v.board = p.board AND v.variant = n.variant AND v.unit = p.unit GROUP BY p.board, n.variant, a, b
UNION ALL SELECT board, 'ordinal', a, b, CAST(sum(s) AS DOUBLE), count(*) FROM p GROUP BY board, a, b"""


@add("c33_variant_support", f"SELECT board, variant, a, b, round(net, 6) AS net, shared FROM ({VARIANTS})")
def c33_variants(spark, d):
    rows = board_scores(spark, d)
    return C.variant_support(C.unit_support(rows, ["board"], soft=False), C.variants(rows, ["board"]), ["board"]).withColumn("net", F.round("net", 6))


@add("c33_stability")
def c33_stability(spark, d):
    rows = checkpointed(board_scores(spark, d))
    parts, design = checkpointed(C.unit_support(rows, ["board"])), C.variants(rows, ["board"])
    net = parts.groupBy("board", "a", "b").agg(F.sum("part").alias("net"))
    places = checkpointed(C.consensus(net, "board", []).select("board", "model", "place"))
    return C.stability(C.variant_support(parts, design, ["board"]), C.still_qualified(rows, design, ["board"], 6), places, ["board"])


@add("c33_coverage", f"SELECT model, round(sum(weight) / (SELECT sum(weight) FROM (SELECT DISTINCT unit, weight FROM ({UNITS}))), 6) AS covered FROM ({UNITS}) WHERE score > 30000 OR unit < 3 GROUP BY 1")
def c33_coverage(spark, d):
    rows = unit_scores(spark, d)
    kept = C.coverage(rows)
    own = rows.where("score > 30000 or unit < 3").groupBy("model").agg(F.sum("weight").alias("own"))
    total = rows.select("unit", "weight").distinct().agg(F.sum("weight").alias("total"))
    return kept.select("model").join(own, "model").crossJoin(F.broadcast(total)).select("model", F.round(F.col("own") / F.col("total"), 6).alias("covered"))


@add("c34_agreement", f"""WITH u AS ({UNITS}), p AS (SELECT model, row_number() OVER (ORDER BY avg(score) DESC) AS place FROM u GROUP BY 1), s AS (SELECT u.*, place FROM u JOIN p USING (model))
SELECT a.unit, round(avg((1 + sign(a.score - b.score) * sign(b.place - a.place)) / 2), 6) AS agreement, count(*) AS pairs FROM s a JOIN s b ON a.unit = b.unit AND a.model < b.model GROUP BY 1""")
def c34(spark, d):
    from pyspark.sql import Window

    rows = unit_scores(spark, d)
    places = rows.groupBy("model").agg(F.avg("score").alias("m")).select("model", F.row_number().over(Window.orderBy(F.col("m").desc())).alias("place"))
    return C.agreement(rows, places)


@add("c34_components", f"SELECT DISTINCT model, (SELECT min(model) FROM ({UNITS})) AS component FROM ({UNITS})")
def c34_components(spark, d):
    return C.connected(C.net_support(unit_scores(spark, d), soft=False))


@add("c35_plausible", """SELECT coalesce(a.k, b.k) AS l_returnflag, coalesce(a.n, 0) AS rows, coalesce(b.n, 0) AS rows_before, 2 * coalesce(a.n, 0) >= coalesce(b.n, 0) AS accepted FROM (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a FULL JOIN (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b ON a.k = b.k""")
def c35(spark, d):
    (li,) = load(spark, d, "lineitem")
    return C.plausible(li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'"), "l_returnflag")


@add("c36_nearest", """WITH p AS (SELECT p_brand AS model, row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_brand) AS place FROM part GROUP BY 1) SELECT model, other, distance, nth FROM (SELECT a.model, b.model AS other, abs(a.place - b.place) AS distance, row_number() OVER (PARTITION BY a.model ORDER BY abs(a.place - b.place), b.place) AS nth FROM p a JOIN p b ON a.model <> b.model) WHERE nth <= 5""")
def c36(spark, d):
    from pyspark.sql import Window

    (p,) = load(spark, d, "part")
    places = p.groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("m")).select("model", F.row_number().over(Window.orderBy(F.col("m").desc(), "model")).cast("long").alias("place"))
    return C.nearest(places)


# Monitor


@add("c37_monitor_events")
def c37(spark, d):
    (conv,) = load(spark, d, "conversations")
    actions = F.lit(["announce", "progress", "confirm", "amend", "withdraw"])
    seen = ts("2024-01-01") + F.make_interval(hours=(F.col("turn") * 5).cast("int"))
    posts = conv.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("post"), (F.col("conv_id") % 20).cast("string").alias("kind"), F.get(actions, F.pmod(F.length("text"), F.lit(5))).alias("action"), seen.alias("at"), F.when(F.length("text") % 3 == 0, seen + F.expr("INTERVAL 2 HOURS")).alias("through"), F.lit(1).alias("count"))
    return MO.assemble(posts)


@add("c38_presentation", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN o_orderkey % 5 = 0 THEN 'in_progress' WHEN o_orderkey % 7 = 0 THEN 'announced' WHEN TIMESTAMP '1997-06-01' < o_orderdate THEN 'announced' WHEN TIMESTAMP '1997-06-01' < o_orderdate + INTERVAL 6 HOUR THEN 'expired_unconfirmed' ELSE 'likely_completed' END AS shown FROM orders""")
def c38(spark, d):
    (o,) = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("announced")
    shown = MO.shown_status(status, F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")), ts("1997-06-01"))
    return o.select("o_orderkey", shown.alias("shown"))
