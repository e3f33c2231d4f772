"""Windows over event time, readers, sinks and board arithmetic on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names as NM
from tidemark.functions import pages as PG
from tidemark.functions import text as TX
from tidemark.operators import grouping as G
from tidemark.operators import neighbours as N
from tidemark.operators import relational as R
from tidemark.plans.registry import Registry
from tidemark.plans.relational import load, ts
from tidemark.session import shared_folder as folder
from tidemark.sources import boards as B
from tidemark.sources import feeds as S
from tidemark.sources import sinks as K
from tidemark.streaming import flows as L

REGISTRY = Registry()
add = REGISTRY.add


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names for checkpoints."""
    return f"{folder(spark).rstrip('/')}/flow-{uuid.uuid4().hex}"


def plain(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@add("r05_sliding", """SELECT event_type, s AS "start", s + INTERVAL 7 DAY AS "end", count(*) AS n, round(sum(value), 3) AS total FROM (SELECT *, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events) GROUP BY 1, 2, 3""")
def r05(spark, d):
    (e,) = load(spark, d, "events")
    return plain(L.windowed(e, "ts", "event_type", "value", "7 days", "1 day"), "start", "end").withColumn("total", F.round("total", 3))


@add("r06_tumbling", """SELECT event_type, date_trunc('hour', ts) AS "start", date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2, 3""")
def r06(spark, d):
    (e,) = load(spark, d, "events")
    return plain(L.windowed(e, "ts", "event_type", "value", "1 hour"), "start", "end").withColumn("total", F.round("total", 3))


@add("r07_budgets", """SELECT user_id, '1 day' AS span, date_trunc('day', ts) AS start, count(*) AS used, CAST(2 AS INTEGER) AS allowed, CASE WHEN count(*) >= 2 THEN CAST(epoch(date_trunc('day', max(ts)) + INTERVAL 1 DAY) - ceil(epoch(max(ts))) AS BIGINT) ELSE 0 END AS wait_seconds FROM events GROUP BY user_id, date_trunc('day', ts)""")
def r07(spark, d):
    (e,) = load(spark, d, "events")
    return plain(L.budgets(e, "ts", "user_id", {"1 day": 2}), "start")


@add("r02_late_split", "SELECT o_orderkey, l_linenumber, l_shipdate - o_orderdate > INTERVAL 48 HOUR AS late FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def r02(spark, d):
    o, li = load(spark, d, "orders", "lineitem")
    # Both sides are dealt to as many tasks, by the size of the larger one.
    size = li.count()
    o, li = R.in_shares(o.select("o_orderkey", "o_orderdate"), "o_orderkey", rows=size), R.in_shares(li.select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey", rows=size)
    rows = o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")
    today, late = L.split_late(rows, "o_orderdate", "l_shipdate")
    pick = lambda df, mark: df.select("o_orderkey", "l_linenumber", F.lit(mark).alias("late"))
    return pick(today, False).unionByName(pick(late, True))


@add("r08_waiting_join", """SELECT p.event_id AS post, r.event_id AS report FROM events p JOIN events r ON p.user_id = r.user_id AND p.event_type = 'click' AND r.event_type = 'purchase' AND r.ts BETWEEN p.ts - INTERVAL 48 HOUR AND p.ts + INTERVAL 48 HOUR""")
def r08(spark, d):
    (e,) = load(spark, d, "events")
    posts = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("post_at"), F.col("event_id").alias("post"))
    reports = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("report_at"), F.col("event_id").alias("report"))
    return L.waiting(posts, reports, "user_id", "post_at", "report_at").select("post", "report")


@add("r09_stream_once", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS h FROM events) GROUP BY 1, 2")
def r09(spark, d):
    """A stream over the table: each batch is reduced to keys, written once, and read back."""
    folder = shared_folder(spark)
    (e,) = load(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")
    hours = stream.select("user_id", "event_type", F.date_trunc("hour", "ts").alias("h"))
    L.run_once(hours, f"{folder}/state", lambda batch, k: batch.distinct().write.mode("overwrite").parquet(f"{folder}/out/batch={k}"))
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type", "h").distinct().groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@add("r04_stream_ledger", "SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id FROM events")
def r04(spark, d):
    """A ledger that a stream appends to, gapless and in order."""
    folder = shared_folder(spark)
    (e,) = load(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").select("ts", "event_id")
    L.run_once(stream, f"{folder}/state", L.ledger_writer(f"{folder}/ledger", ["ts", "event_id"]))
    return L.read_ledger(spark, f"{folder}/ledger").select("seq", "event_id")


@add("r14_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def r14(spark, d):
    (e,) = load(spark, d, "events")
    return plain(L.sessions(e, "ts", "user_id", "6 hours"), "start", "end")


# Readers


@add("s01_feed_entries", """SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, 'Report ' || doc_id AS title, 'https://example.org/' || doc_id AS url, '2024-01-15T10:00:00Z' AS published FROM documents""")
def s01(spark, d):
    (docs,) = load(spark, d, "documents")
    k = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title>Report "), k, F.lit("</title><link>https://example.org/"), k, F.lit("</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>"))
    # A source's feed comes in pages, a block of ids each, so pages grow in number with the table and not in size.
    rows = docs.groupBy("source", F.floor(F.col("doc_id") / 500).alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("i"))
    body = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("i", lambda s: s["x"]), ""), F.lit("</channel></rss>"))
    return S.parse_feeds(rows.select("source", "page", body.alias("body"))).select("source", "place", "title", "url", "published")


@add("s02_changed_listings", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def s02(spark, d):
    (p,) = load(spark, d, "pages")
    listings = p.select(F.col("page_id").alias("source"), F.lit(None).cast("string").alias("etag"), F.col("html").alias("body"))
    state = p.where("page_id % 3 = 0").select(F.col("page_id").alias("source"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("mark"))
    return S.changed(listings, state).select(F.col("source").alias("page_id"))


@add("s03_json_list", """SELECT user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, json_extract_string(props, '$.k') AS k, 'https://example.org/' || json_extract_string(props, '$.k') || '/x' AS url FROM events""")
def s03(spark, d):
    (e,) = load(spark, d, "events")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda s: s["props"])
    bodies = e.groupBy(F.col("user_id").alias("source")).agg(F.concat(F.lit('{"data": ['), F.array_join(listed, ","), F.lit("]}")).alias("body"))
    out = S.json_items(bodies, "$.data", {"k": "$.k", "url": "https://example.org/{k}/x"})
    return out.withColumn("place", F.col("place").cast("long"))


@add("s08_page_links", r"""SELECT page_id, l AS url FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1)) AS l FROM pages)""")
def s08(spark, d):
    (p,) = load(spark, d, "pages")
    return S.html_links(p.select(F.col("page_id").alias("source"), F.col("html").alias("body")), "nav ul").select(F.col("source").cast("long").alias("page_id"), "url")


@add("s09_markdown_links", """SELECT doc_id % 7 AS source, 'Doc ' || doc_id AS title, '/d/' || doc_id AS url FROM documents""")
def s09(spark, d):
    (docs,) = load(spark, d, "documents")
    k = F.col("doc_id").cast("string")
    line = F.concat(F.lit("- [Doc "), k, F.lit("](/d/"), k, F.lit(') and [not](this)\n![pic](x.png)'))
    bodies = docs.groupBy((F.col("doc_id") % 7).alias("source"), F.floor(F.col("doc_id") / 500)).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return S.markdown_links(bodies).select("source", "title", "url")


@add("s18_push_batch", """SELECT page_id, CASE WHEN bool_or(host = '') OVER (PARTITION BY batch) OR count(*) OVER (PARTITION BY batch) > 50 THEN 'invalid' WHEN row_number() OVER (PARTITION BY batch, host ORDER BY page_id) = 1 THEN 'accepted' ELSE 'repeated' END AS status
FROM (SELECT page_id, CASE WHEN page_id % 300 < 60 THEN page_id // 300 * 300 ELSE page_id // 40 END AS batch, CASE WHEN page_id % 97 <> 5 THEN coalesce(regexp_extract(url, '^https?://([^/]+)', 1), '') ELSE '' END AS host FROM pages)""")
def s18(spark, d):
    """All pages, in batches of 40 and, every 300 pages, one of 60, which is too large."""
    (p,) = load(spark, d, "pages")
    host = F.when(F.col("page_id") % 97 != 5, F.coalesce(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit(""))).otherwise("")
    batch = F.when(F.col("page_id") % 300 < 60, F.floor(F.col("page_id") / 300) * 300).otherwise(F.floor(F.col("page_id") / 40))
    rows = p.select(batch.alias("batch"), F.col("page_id").alias("place"), F.concat(F.lit("https://"), host).alias("url"), F.lit("t").alias("title"))
    return S.pushed(rows).select(F.col("place").alias("page_id"), "status")


@add("s21_gold_lines", "SELECT doc_id AS id, quality FROM labels WHERE quality IS NOT NULL")
def s21(spark, d):
    (labels,) = load(spark, d, "labels")
    rows = labels.where("quality is not null").select(F.col("doc_id").alias("id"), "quality")
    lines = K.gold_jsonl(rows, "id").unionByName(spark.createDataFrame([("// a note",), ("",)], "value string"))
    return S.gold_lines(lines, f"id long, quality {rows.schema['quality'].dataType.simpleString()}")


@add("e04_bounds_ranks", "SELECT p_partkey AS model, p_brand AS board, p_retailprice AS score, p_retailprice - p_size AS low, p_retailprice + p_size AS high, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS place FROM part WHERE p_retailprice IS NOT NULL")
def e04(spark, d):
    (p,) = load(spark, d, "part")
    out = B.ranked(B.scored(p, F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")))
    return out.withColumn("model", F.col("model").cast("long"))


@add("e06_category_means", """WITH s AS (SELECT l_suppkey AS model, l_linenumber AS task, avg(l_quantity) AS score FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2), c AS (SELECT DISTINCT task, task % 3 AS category FROM s), p AS (SELECT category, count(*) AS n FROM c GROUP BY 1),
m AS (SELECT model, category, avg(score) AS m, count(*) AS h FROM s JOIN c USING (task) GROUP BY 1, 2) SELECT model, round(avg(m), 6) AS score FROM m JOIN p USING (category) WHERE h = n GROUP BY model HAVING count(*) = (SELECT count(*) FROM p)""")
def e06(spark, d):
    (li,) = load(spark, d, "lineitem")
    scores = li.where("l_quantity > 20").groupBy(F.col("l_suppkey").alias("model"), F.col("l_linenumber").alias("task")).agg(F.avg("l_quantity").alias("score"))
    categories = scores.select("task", (F.col("task") % 3).alias("category")).distinct()
    return B.category_means(scores, categories).withColumn("score", F.round("score", 6))


@add("e07_carried_share", "SELECT p_partkey FROM (SELECT *, avg(CASE WHEN p_size > 20 THEN 1.0 ELSE 0 END) OVER (PARTITION BY p_brand) AS s FROM part) WHERE s >= 0.6 AND p_size > 20")
def e07(spark, d):
    (p,) = load(spark, d, "part")
    return B.carried_share(p.withColumn("board", F.col("p_brand")), F.col("p_size") > 20, 0.6).select("p_partkey")


@add("e16_numeric_text_ids", "SELECT event_type, CAST(max(event_id) AS VARCHAR) AS latest FROM events GROUP BY 1")
def e16(spark, d):
    (e,) = load(spark, d, "events")
    text = F.col("event_id").cast("string")
    return e.groupBy("event_type").agg(F.max(F.struct(F.length(text).alias("n"), text.alias("t")))["t"].alias("latest"))


@add("e20_latest_urls", "SELECT host, string_agg(url, ' ' ORDER BY page_id DESC) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS n FROM (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages)) WHERE n <= 10 GROUP BY host")
def e20(spark, d):
    (p,) = load(spark, d, "pages")
    rows = p.select(F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("source"), "url", F.col("page_id").alias("at"))
    return K.latest_by_source(rows).select(F.col("source").alias("host"), F.array_join("urls", " ").alias("urls"))


# Sinks


@add("k06_sitemap", "SELECT url, max(page_id) AS changed FROM pages WHERE url IS NOT NULL GROUP BY url")
def k06(spark, d):
    (p,) = load(spark, d, "pages")
    return K.sitemap(p.select("url", F.col("page_id").alias("changed"))).select("url", "changed")


@add("k05_feed", "SELECT count(*) AS n, max(doc_id) AS newest FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50)")
def k05(spark, d):
    """The feed's items, counted in its text; the newest comes first."""
    (docs,) = load(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), (ts("2024-01-01") + F.make_interval(hours=F.col("doc_id").cast("int"))).alias("at"), F.col("text").alias("summary"))
    xml = K.rss(items, "All", "https://example.org/")
    return xml.select(F.size(F.regexp_extract_all("xml", F.lit("<item>"), F.lit(0))).cast("long").alias("n"), F.regexp_extract("xml", r'isPermaLink="false">(\d+)<', 1).cast("long").alias("newest"))


@add("k08_markdown", "SELECT doc_id AS id, '# ' || trim(source) || chr(10) || chr(10) || '- Source: ' || trim(source) || chr(10) || '- Date: 2024-01-02' AS markdown FROM documents WHERE trim(coalesce(source, '')) <> '' UNION ALL SELECT doc_id, '- Date: 2024-01-02' FROM documents WHERE trim(coalesce(source, '')) = ''")
def k08(spark, d):
    (docs,) = load(spark, d, "documents")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), none.alias("url"), "source", ts("2024-01-02").alias("at"), none.alias("summary"), none.alias("body"))
    return K.markdown(rows)


# Vectors


@add("j15_best_neighbour", """SELECT query, vec_id AS nearest FROM (SELECT q.vec_id AS query, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS n FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE n = 1""")
def j15(spark, d):
    """Each stated query against all rows, by lists that the triangle inequality prunes."""
    (e,) = load(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found, _ = N.nearest(rows.where("id % 20 = 0").withColumnRenamed("id", "query"), rows)
    return found.select("query", "nearest")


# Grouping and delivery


@add("c17_grouping", """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 31 = 0 AS dup, o_orderkey % 29 = 0 AS man, o_orderkey % 23 = 0 AS his, o_orderkey % 19 = 0 AS sig, o_orderkey % 17 = 0 AS pro, o_orderkey % 13 = 0 AS cur, o_orderkey % 11 = 0 AS rel, o_orderkey % 7 = 0 AS url, CASE o_orderkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'development' WHEN 2 THEN 'roundup' END AS a, o_custkey AS f FROM orders),
x AS (SELECT *, CASE WHEN dup THEN 'skipped' WHEN man THEN 'manual' WHEN his THEN 'archived' WHEN sig THEN 'signal' WHEN pro THEN 'standalone' WHEN cur THEN 'kept' WHEN rel THEN 'not_relevant' WHEN url THEN 'same_url' WHEN a = 'same' THEN 'same_fact' WHEN a IS NOT NULL THEN a ELSE 'new_story' END AS action FROM r)
SELECT id, action, CASE WHEN action = 'manual' THEN 1 WHEN action = 'kept' THEN 2 WHEN action = 'same_url' THEN 3 WHEN action IN ('same_fact', 'development') THEN f END AS fact FROM x""")
def c17(spark, d):
    (o,) = load(spark, d, "orders")
    k = F.col("o_orderkey")
    hit = lambda m, v: F.when(k % m == 0, v)
    reports = o.select(k.alias("id"), hit(31, k).alias("duplicate_of"), hit(29, F.lit(1).cast("long")).alias("manual_fact"), (k % 23 == 0).alias("historical"), (k % 19 == 0).alias("is_signal"), (k % 17 == 0).alias("promotion"), hit(13, F.lit(2).cast("long")).alias("current_fact"), F.when(k % 11 == 0, "block").otherwise("pass").alias("relevance"), hit(7, F.lit(3).cast("long")).alias("url_fact"))
    action = F.when(k % 4 == 0, "same").when(k % 4 == 1, "development").when(k % 4 == 2, "roundup")
    return G.grouping(reports, o.where(action.isNotNull()).select(k.alias("query"), action.alias("action"), F.col("o_custkey").alias("fact")))


ONE_BY_ONE = """WITH RECURSIVE r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY coalesce(n_chars, 0) % 50, doc_id) AS n, CASE WHEN doc_id % 31 = 0 THEN 'skipped' WHEN doc_id % 29 = 0 THEN 'manual' WHEN doc_id % 23 = 0 THEN 'archived' WHEN doc_id % 19 = 0 THEN 'signal' WHEN doc_id % 17 = 0 THEN 'standalone' WHEN doc_id % 13 = 0 THEN 'kept' WHEN coalesce(n_chars, 0) % 11 = 0 THEN 'not_relevant' END AS own FROM documents),
f AS (SELECT CAST(-1 - n_nationkey AS BIGINT) AS fact, CAST(-1 - n_regionkey AS BIGINT) AS story FROM nation),
e AS (SELECT id AS query, id - k AS other, ['same', 'development', 'url', 'roundup'][1 + (id + k) % 4] AS action, id * k % 3 AS nth FROM r, (VALUES (1), (2), (5), (9)) t(k) WHERE (id * 7 + k) % 3 > 0 UNION ALL SELECT id, -1 - id % 40, 'same', 1 FROM r WHERE id % 6 = 0),
c AS (SELECT query, list(struct_pack(nth := nth, other := other, action := action) ORDER BY nth, other, action) AS l FROM e LEFT JOIN f ON fact = other JOIN r q ON q.id = query LEFT JOIN r o ON o.id = other WHERE fact IS NOT NULL OR o.n < q.n GROUP BY 1),
o AS (SELECT r.*, coalesce(l, []) AS l FROM r LEFT JOIN c ON query = id),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS fact, CAST(NULL AS BIGINT) AS story, (SELECT list(struct_pack(fact := fact, story := story)) FROM f) AS known
UNION ALL SELECT n, id, action, fact, story, CASE WHEN action IN ('new_story', 'development') THEN list_append(known, struct_pack(fact := fact, story := story)) ELSE known END FROM
 (SELECT n, id, action, fact, known, CASE action WHEN 'new_story' THEN id WHEN 'roundup' THEN NULL WHEN 'development' THEN list_filter(known, lambda k: k.fact = hit.other)[1].story ELSE list_filter(known, lambda k: k.fact = b.fact)[1].story END AS story FROM
  (SELECT *, CASE action WHEN 'manual' THEN -1 WHEN 'kept' THEN -2 WHEN 'same_fact' THEN hit.other WHEN 'same_url' THEN hit.other WHEN 'new_story' THEN id WHEN 'development' THEN id END AS fact FROM
   (SELECT *, coalesce(own, CASE hit.action WHEN 'same' THEN 'same_fact' WHEN 'url' THEN 'same_url' ELSE hit.action END, 'new_story') AS action FROM
    (SELECT o.n, o.id, own, known, list_filter(l, lambda x: list_contains(list_transform(known, lambda k: k.fact), x.other))[1] AS hit FROM s JOIN o ON o.n = s.n + 1))) b))
SELECT id, action, fact, story FROM s WHERE n > 0"""


@add("c17_in_order", ONE_BY_ONE)
def c17_in_order(spark, d):
    docs, nation = load(spark, d, "documents", "nation")
    k, size = F.col("doc_id"), F.coalesce("n_chars", F.lit(0))
    hit = lambda m, v: F.when(k % m == 0, F.lit(v).cast("long"))
    reports = docs.select(k.alias("id"), (size % 50).alias("place"), F.when(k % 31 == 0, k).alias("duplicate_of"), hit(29, -1).alias("manual_fact"), (k % 23 == 0).alias("historical"), (k % 19 == 0).alias("is_signal"), (k % 17 == 0).alias("promotion"), hit(13, -2).alias("current_fact"), F.when(size % 11 == 0, "block").otherwise("pass").alias("relevance"))
    back = F.explode(F.array(*map(F.lit, (1, 2, 5, 9))))
    action = F.get(F.array(*map(F.lit, ("same", "development", "url", "roundup"))), ((k + F.col("k")) % 4).cast("int"))
    earlier = docs.select("doc_id", back.alias("k")).where((k * 7 + F.col("k")) % 3 > 0).select(k.alias("query"), (k - F.col("k")).alias("other"), action.alias("action"), (k * F.col("k") % 3).alias("nth"))
    before = docs.where(k % 6 == 0).select(k.alias("query"), (-1 - k % 40).alias("other"), F.lit("same").alias("action"), F.lit(1).cast("long").alias("nth"))
    facts = nation.select((-1 - F.col("n_nationkey")).cast("long").alias("fact"), (-1 - F.col("n_regionkey")).cast("long").alias("story"))
    return G.grouping_in_order(reports, earlier.unionByName(before), facts)


@add("c18_signal_targets", """WITH s AS (SELECT event_id AS post, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS ref, ts FROM events WHERE event_type = 'click'), f AS (SELECT event_id AS m, user_id AS fact, ts FROM events WHERE event_type <> 'click'),
q AS (SELECT post, arg_min(fact, (f.ts, fact)) AS quoted FROM s JOIN f ON ref = m GROUP BY 1), l AS (SELECT post, arg_min(fact, (f.ts, fact)) AS linked FROM s JOIN f ON post % 2 = 0 AND m = post + 1 AND f.ts > s.ts - INTERVAL 120 DAY GROUP BY 1)
SELECT post, coalesce(quoted, linked, CASE WHEN post % 5 = 0 THEN post END) AS fact, CASE WHEN quoted IS NOT NULL THEN 'quoted' WHEN linked IS NOT NULL THEN 'linked' WHEN post % 10 = 0 THEN 'similar' ELSE 'judge' END AS how FROM s LEFT JOIN q USING (post) LEFT JOIN l USING (post) WHERE quoted IS NOT NULL OR linked IS NOT NULL OR post % 5 = 0""")
def c18(spark, d):
    (e,) = load(spark, d, "events")
    posts = e.where("event_type = 'click'")
    i = F.col("event_id")
    signals = posts.select(i.alias("post"), F.when(i % 3 == 0, i - 1).alias("reference"), F.col("ts").alias("at"))
    facts = e.where("event_type <> 'click'").select(i.alias("member"), F.col("user_id").alias("fact"), F.col("ts").alias("at"))
    links = posts.where("event_id % 2 = 0").select(i.alias("post"), (i + 1).alias("report"))
    similar = posts.where("event_id % 5 = 0").select(i.alias("post"), i.alias("fact"), F.when(i % 10 == 0, 0.95).otherwise(0.8).alias("score"))
    return G.signal_targets(signals, facts, links, similar)


@add("e11_story_picks", """SELECT story, heat, reports FROM (SELECT l_suppkey AS story, max(CASE WHEN l_quantity > 25 THEN l_quantity END) AS heat, string_agg(DISTINCT l_linenumber::VARCHAR, ' ' ORDER BY l_linenumber::VARCHAR) AS reports FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity > 25) AND bool_or(l_returnflag = 'R')) ORDER BY heat DESC, story LIMIT 15""")
def e11(spark, d):
    (li,) = load(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("story"), F.col("l_linenumber").cast("string").alias("report"), F.col("l_quantity").alias("heat"), (F.col("l_quantity") > 25).alias("fresh"), (F.col("l_returnflag") == "R").alias("official"))
    return G.story_picks(rows, 15).withColumn("reports", F.array_join("reports", " "))


@add("e15_owed", """SELECT e.event_id AS post, c_custkey AS target FROM events e JOIN customer ON c_custkey = e.user_id UNION SELECT e.event_id, c_custkey FROM events e JOIN customer ON c_custkey = e.user_id % 700 + 100
EXCEPT SELECT event_id, user_id FROM events WHERE event_id % 2 = 0""")
def e15(spark, d):
    e, c = load(spark, d, "events", "customer")
    posts = e.select(F.col("event_id").alias("post"), F.array(F.concat(F.lit("a"), F.col("user_id").cast("string")), F.concat(F.lit("b"), (F.col("user_id") % 700).cast("string"))).alias("kinds"))
    named = lambda mark, k: c.select(F.col("c_custkey").alias("target"), F.concat(F.lit(mark), k.cast("string")).alias("kind"))
    targets = named("a", F.col("c_custkey")).unionByName(named("b", F.col("c_custkey") - 100))
    sent = e.where("event_id % 2 = 0").select(F.col("event_id").alias("post"), F.col("user_id").alias("target"))
    return G.owed(posts, targets, sent)


@add("e17_verified_mark", "SELECT user_id AS source, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN max(event_id) ELSE max(event_id - 100) END AS mark FROM events GROUP BY 1")
def e17(spark, d):
    (e,) = load(spark, d, "events")
    return G.verified_mark(e.select(F.col("user_id").alias("source"), F.col("event_id").alias("mark"), (F.col("event_id") - 100).alias("verified"), (F.col("event_type") == "error").cast("int").alias("pending")))


@add("e18_open_events", """WITH o AS (SELECT user_id AS kind, ts, event_type AS text, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 30 HOUR END AS through, event_id % 7 = 0 AS gone FROM events) SELECT kind, min(ts) AS first_at, arg_min(text, (ts, text)) AS text FROM o
WHERE NOT gone AND (through IS NULL AND ts > TIMESTAMP '2024-01-15' - INTERVAL 24 HOUR OR through > TIMESTAMP '2024-01-15') GROUP BY 1 ORDER BY first_at, kind LIMIT 8""")
def e18(spark, d):
    (e,) = load(spark, d, "events")
    rows = e.select(F.col("user_id").alias("kind"), F.col("ts").alias("at"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("INTERVAL 30 HOURS")).alias("through"), F.when(F.col("event_id") % 7 == 0, "withdrawn").otherwise("announced").alias("status"))
    return G.open_events(rows, ts("2024-01-15"))


# Pages and names


@add("c48_bodies")
def c48(spark, d):
    (p,) = load(spark, d, "pages")
    return PG.extract(p).withColumn("page_id", F.col("page_id").cast("long")).select("page_id", "title", "body", "status")


@add("s13_detail_fill", r"""SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 2 = 0 THEN 'Listed' ELSE '' END), ''), nullif(trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '')) AS title FROM pages""")
def s13(spark, d):
    (p,) = load(spark, d, "pages")
    rows = p
    listed = rows.select("page_id", F.when(F.col("page_id") % 2 == 0, "Listed").otherwise("").alias("title"))
    return PG.filled(listed, rows.select("page_id", PG.page_title(F.col("html")).alias("title")), "page_id", ["title"])


@add("s11_script_records", "SELECT page_id, CAST(len(regexp_extract_all(html, '<script>(.*?)</script>', 1)) AS BIGINT) AS n FROM (SELECT page_id, replace(html, '<script type=\"x\">', '<script>') AS html FROM pages)")
def s11(spark, d):
    (p,) = load(spark, d, "pages")
    typed = F.replace("html", F.lit("<script>"), F.lit('<script type="x">'))
    return p.select("page_id", F.size(PG.script_records(typed, "x")).cast("long").alias("n"))


@add("t33_text_to_html", r"""SELECT doc_id, coalesce(list_aggregate(list_transform(list_filter(list_transform(regexp_split_to_array(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '\n\s*\n'), lambda x: trim(x, ' ')), lambda p: p <> ''), lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>'), 'string_agg', ''), CASE WHEN text IS NOT NULL THEN '' END) AS html FROM documents""")
def t33(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", PG.text_to_html(F.col("text")).alias("html"))


@add("t35_shielding", r"""SELECT page_id, html IS NOT NULL AS restored, CAST(len(regexp_extract_all(coalesce(html, ''), '(?s)<(?:code|pre)>.*?</(?:code|pre)>|<[^>]+>')) AS BIGINT) AS parts, NOT regexp_matches(coalesce(html, '<p>'), '(?s)<(?:code|pre)>.*?</(?:code|pre)>|<[^>]+>') AS whole FROM pages""")
def t35(spark, d):
    """What comes back through the marks is the page; without the first of them nothing does."""
    (p,) = load(spark, d, "pages")
    cut = p.withColumn("s", PG.shielded(F.col("html")))
    back = lambda text: PG.unshielded(text, F.col("s.parts"))
    return cut.select("page_id", F.coalesce(back(F.col("s.text")) == F.col("html"), F.lit(False)).alias("restored"), F.coalesce(F.size("s.parts"), F.lit(0)).cast("long").alias("parts"), back(F.replace("s.text", F.lit("⟦0⟧"), F.lit(""))).isNotNull().alias("whole"))


@add("t12_labelled_output", "SELECT doc_id, nullif(trim(coalesce(source, '')), '') AS title, nullif(trim(coalesce(lang, '')), '') AS summary FROM documents")
def t12(spark, d):
    (docs,) = load(spark, d, "documents")
    said = lambda c: F.coalesce(c, F.lit(""))
    answer = F.concat(F.lit("title_zh: "), said("source"), F.lit("\nnote: none\nsummary_zh: "), said("lang"), F.lit("\n"))
    parts = PG.labelled(answer, ["title_zh", "note", "summary_zh"])
    return docs.select("doc_id", parts["title_zh"].alias("title"), parts["summary_zh"].alias("summary"))


@add("t27_quoted", r"""WITH l AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[\s\p{P}\p{S}]+', '', 'g') AS t, regexp_replace(lower(coalesce(substr(text, 1, 40), '')), '[\s\p{P}\p{S}]+', '', 'g') AS a, regexp_replace(lower(coalesce(substr(text, 60, 30), '')), '[\s\p{P}\p{S}]+', '', 'g') AS b FROM documents)
SELECT doc_id, (a <> '' OR b <> '') AND contains(t, a) AND contains(t, b) AS own, contains(t, a || 'x') AND contains(t, 'the') AS other FROM l""")
def t27(spark, d):
    """Two places of a text as a quote with something left out, and one that most texts don't have."""
    (docs,) = load(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    # Dots that a place may hold itself would leave something out too.
    place = lambda at, n: F.replace(F.substring(text, at, n), F.lit("."), F.lit(" "))
    quote = F.concat(F.lit("«"), place(1, 40), F.lit(" ... "), place(60, 30), F.lit("»"))
    return docs.select("doc_id", PG.quoted_in(quote, text).alias("own"), PG.quoted_in(F.concat(place(1, 40), F.lit("x … The")), text).alias("other"))


@add("t30_configuration", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'effort' WHEN 1 THEN 'thinking' ELSE 'plain' END AS tier, CASE event_id % 4 WHEN 0 THEN 'high' END AS effort FROM events")
def t30(spark, d):
    (e,) = load(spark, d, "events")
    k = F.col("event_id") % 4
    text = F.when(k == 0, "Reasoning (HIGH)").when(k == 1, "extended thinking").when(k == 2, "non-thinking, high")
    return e.withColumn("c", NM.configuration(text)).select("event_id", "c.tier", "c.effort")


@add("t13_unsupported_names", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN '' ELSE 'licence' END AS missing FROM documents WHERE text IS NOT NULL")
def t13(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.where("text is not null").select("doc_id", F.array_join(NM.unsupported_names(F.lit("a license"), F.col("text"), {"licence": "(?i)license", "other": "zzzz"}), " ").alias("missing"))


@add("t32_phrases")
def t32(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", NM.distinctive_phrase(F.col("text")).alias("phrase"))


@add("t17_same_title")
def t17(spark, d):
    (docs,) = load(spark, d, "documents")
    title = F.substring("text", 1, 60)
    return docs.select("doc_id", NM.same_title(title, F.concat(F.upper(title), F.lit("!"))).alias("same"), NM.same_title(title, F.substring("text", 1, 20)).alias("prefix"))


HAN_DIGITS = "零一二三四五六七八九"


def _han(number: str) -> str:
    return f"translate(CAST({number} AS STRING), '0123456789', '{HAN_DIGITS}')"


E12_COLUMNS = ["doc_id", f"{_han('(doc_id + 11) * 7919')} AS phrase", "substr(text, 1, 40) AS report", "substr(text, CAST(1 + 6 * (doc_id % 8) AS INT), 40) AS title", f"concat({_han('(doc_id + 3) * 15485863')}, ' x ', {_han('(doc_id + 5) * 49979687')}) AS body"]
E12_GRAMS = r"(SELECT DISTINCT doc_id, s[i:i+1] AS v FROM (SELECT doc_id, s, unnest(range(1, length(s))) AS i FROM (SELECT doc_id, regexp_replace(lower({c}), '[\p{{P}}\p{{S}}\s_]+', '', 'g') AS s FROM p)))"


@add("e12_rule_match", f"""WITH p AS (SELECT {", ".join(E12_COLUMNS)} FROM documents WHERE text IS NOT NULL),
t AS {E12_GRAMS.format(c="title")}, r AS {E12_GRAMS.format(c="report")},
d AS (SELECT doc_id, coalesce(2.0 * n / (nt + nr), 0) >= 0.3 AS alike FROM p LEFT JOIN (SELECT doc_id, count(*) AS n FROM t JOIN r USING (doc_id, v) GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS nt FROM t GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS nr FROM r GROUP BY 1) USING (doc_id)),
w AS (SELECT doc_id, title || chr(10) || body AS s, phrase[i:i+1] AS v, i FROM (SELECT *, unnest(range(1, length(phrase))) AS i FROM p)),
f AS (SELECT doc_id, v, i, instr(s, v) AS a, length(s) - instr(reverse(s), reverse(v)) AS z FROM w WHERE contains(s, v))
SELECT doc_id, alike OR doc_id IN (SELECT x.doc_id FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.v <> y.v AND abs(x.i - y.i) >= 2 AND x.a + 2 <= y.z) AS matched FROM d""")
def e12(spark, d):
    (docs,) = load(spark, d, "documents")
    posts = docs.where("text is not null").selectExpr(*E12_COLUMNS).withColumn("reports", F.array("report"))
    return NM.rule_match(posts).select("doc_id", "matched")


# More readers


@add("s06_embedded_json", """SELECT event_id, props AS json FROM events""")
def s06(spark, d):
    (e,) = load(spark, d, "events")
    body = F.concat(F.lit('<script>var a = 1; window.STATE = '), F.col("props"), F.lit("; f({})</script>"))
    return S.embedded_json(e.select(F.col("event_id").alias("source"), body.alias("body")), "STATE").select(F.col("source").cast("long").alias("event_id"), "json")


@add("s10_changelog", """SELECT doc_id % 9 AS source, 2 * (dense_rank() OVER (PARTITION BY doc_id % 9 ORDER BY doc_id) - 1) + k AS place, DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS day FROM documents, (SELECT unnest([0, 1]) AS k)""")
def s10(spark, d):
    (docs,) = load(spark, d, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    part = F.concat(F.lit("# "), day, F.lit("\n## Fixed\ntext\n"))
    # Nine sources, each in pages of a block of ids.
    rows = docs.groupBy((F.col("doc_id") % 9).alias("source"), F.floor(F.col("doc_id") / 900).alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("x")))).alias("p"))
    bodies = rows.select("source", "page", F.concat(F.lit("intro\n"), F.array_join(F.transform("p", lambda s: s["x"]), "")).alias("body"))
    return S.changelog(bodies).select("source", F.col("place").cast("long").alias("place"), "day")


@add("s14_unread_posts", "SELECT event_id FROM events WHERE event_type <> 'error' AND (user_id % 3 = 0 OR event_id > 5000 OR event_id > 100 AND event_id <= 200)")
def s14(spark, d):
    (e,) = load(spark, d, "events")
    text = F.col("event_id").cast("string")
    posts = e.select(F.col("user_id").alias("account"), text.alias("post_id"), (F.col("event_type") == "error").alias("repost"))
    number = lambda n: F.lit(n).cast("decimal(20,0)")
    marks = e.where("user_id % 3 > 0").select(F.col("user_id").alias("account"), F.lit("5000").alias("mark"), F.array(F.struct(number(100).alias("from"), number(200).alias("to"))).alias("backlog")).distinct()
    return S.unread(posts.unionByName(posts.limit(50)), marks).select(F.col("post_id").cast("long").alias("event_id"))


@add("s15_account_shards", """WITH RECURSIVE a AS (SELECT c_mktsegment AS mode, 'handle_' || c_custkey AS handle, length('handle_' || c_custkey) + 9 AS cost, row_number() OVER (PARTITION BY c_mktsegment ORDER BY 'handle_' || c_custkey) AS n FROM customer),
x AS (SELECT a.mode, a.n, max(b.n) + 1 AS nxt FROM a JOIN (SELECT y.mode, y.n AS at, z.n, sum(z.cost) OVER (PARTITION BY y.mode, y.n ORDER BY z.n) AS used FROM a y JOIN a z ON z.mode = y.mode AND z.n BETWEEN y.n AND y.n + 23) b ON b.mode = a.mode AND b.at = a.n AND b.used <= 470 GROUP BY 1, 2),
w AS (SELECT mode, CAST(1 AS BIGINT) AS n, 0 AS shard FROM (SELECT DISTINCT mode FROM a) UNION ALL SELECT x.mode, x.nxt, w.shard + 1 FROM w JOIN x ON x.mode = w.mode AND x.n = w.n WHERE x.nxt <= (SELECT max(n) FROM a WHERE a.mode = x.mode))
SELECT a.mode, a.handle, max(w.shard) AS shard FROM a JOIN w ON w.mode = a.mode AND w.n <= a.n GROUP BY 1, 2""")
def s15(spark, d):
    (c,) = load(spark, d, "customer")
    return S.account_shards(c.select(F.col("c_mktsegment").alias("mode"), F.concat(F.lit("handle_"), F.col("c_custkey").cast("string")).alias("handle")))


@add("s16_post_candidates", r"""SELECT 'https://x.com/' || source || '/status/' || doc_id AS url, substr(trim(split_part(text, chr(10), 1), ' '), 1, 200) AS title, source AS author FROM documents WHERE text IS NOT NULL""")
def s16(spark, d):
    (docs,) = load(spark, d, "documents")
    posts = docs.where("text is not null").select(F.col("source").alias("handle"), F.col("doc_id").cast("string").alias("post_id"), "text", ts("2024-01-01").alias("at"), F.lit(None).cast("string").alias("quoted"))
    return S.post_candidates(posts).select("url", "title", "author")


@add("s17_own_posts", "SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-15'")
def s17(spark, d):
    (e,) = load(spark, d, "events")
    return S.own_posts(e.select(F.col("event_type").alias("account"), F.col("event_id").alias("post_id"), F.col("ts").alias("at")), "click", ts("2024-01-15")).select(F.col("post_id").alias("event_id"))


@add("f17_listing_filters", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'a') AND NOT regexp_matches(p_brand, '1$') AND p_retailprice > 950 AND p_size >= 10")
def f17(spark, d):
    (p,) = load(spark, d, "part")
    rows = p.withColumn("dear", F.col("p_retailprice") > 950)
    return S.listing_filter(rows, ("p_name", "a"), ("p_brand", "1$"), "dear", ("p_size", 10)).select("p_partkey")


@add("t21_lead_item", r"""WITH t AS (SELECT doc_id, doc_id % 40 AS report, regexp_replace(substr(text, 1, 60), '\s', '', 'g') AS s FROM documents), g AS (SELECT doc_id, report, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS b FROM t),
h AS (SELECT report, b AS hb FROM g QUALIFY row_number() OVER (PARTITION BY report ORDER BY doc_id) = 1), x AS (SELECT report, doc_id, len(list_intersect(b, hb)) / least(len(b), len(hb)) AS share FROM g JOIN h USING (report) WHERE len(b) > 0 AND len(hb) > 0) SELECT report, arg_max(doc_id, (share, -doc_id)) AS lead FROM x WHERE share >= 0.5 GROUP BY 1""")
def t21(spark, d):
    (docs,) = load(spark, d, "documents")
    rows = docs.select("doc_id", (F.col("doc_id") % 40).alias("report"), F.substring("text", 1, 60).alias("title"))
    heads = rows.groupBy("report").agg(F.min_by("title", "doc_id").alias("headline"))
    return TX.lead_item(rows.join(heads, "report"), "report", "doc_id", F.col("title"), F.col("headline"))


@add("e13_fragments", "SELECT doc_id, true AS whole, false AS none FROM documents")
def e13(spark, d):
    (docs,) = load(spark, d, "documents")
    text = F.concat(F.lit("中文内容 "), F.coalesce("text", F.lit("")), F.lit(" 模型发布"))
    return docs.select("doc_id", NM.han_fragments_in(F.lit("模型发布, 中文"), text).alias("whole"), NM.han_fragments_in(F.lit("no han"), text).alias("none"))


@add("e19_feedback_list", "SELECT e.event_id, CAST((SELECT count(*) FROM events o WHERE o.user_id = e.user_id) AS BIGINT) AS of_user, EXISTS (SELECT 1 FROM orders WHERE o_custkey = e.user_id) AS answered FROM events e WHERE e.event_type = 'error'")
def e19(spark, d):
    """Counts and flags are joined by key once, in place of a subquery for each row."""
    e, o = load(spark, d, "events", "orders")
    counts = e.groupBy("user_id").agg(F.count("*").alias("of_user"))
    known = o.select(F.col("o_custkey").alias("user_id")).distinct().withColumn("_known", F.lit(True))
    rows = e.where("event_type = 'error'").join(counts, "user_id").join(known, "user_id", "left")
    return rows.select("event_id", "of_user", F.coalesce("_known", F.lit(False)).alias("answered"))


@add("e21_engagement_order", "SELECT query, post, points FROM (SELECT l_suppkey AS query, l_orderkey * 10 + l_linenumber AS post, CAST(l_quantity AS BIGINT) + 2 * l_linenumber + l_partkey % 7 AS points, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS BIGINT) + 2 * l_linenumber + l_partkey % 7 DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n <= 5")
def e21(spark, d):
    (li,) = load(spark, d, "lineitem")
    posts = li.select(F.col("l_suppkey").alias("query"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("post"), F.col("l_quantity").cast("long").alias("likes"), F.col("l_linenumber").alias("reposts"), (F.col("l_partkey") % 7).alias("replies"))
    return G.most_engaging(posts, 5)
