"""Queries of the read layer's filters, sweeps, board readers and agent texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import math as M
from tidemark.functions import text as TX
from tidemark.operators import publish as P
from tidemark.operators import reading as V
from tidemark.operators import search as SE
from tidemark.plans.domain import PUB, at, publications
from tidemark.plans.registry import Registry
from tidemark.plans.relational import load, ts
from tidemark.session import shared_folder
from tidemark.sources import boards as B
from tidemark.sources import listing as LI
from tidemark.sources import sinks as K

REGISTRY = Registry()
add = REGISTRY.add
AT = "TIMESTAMP '2024-01-20 00:00:00'"
INDUSTRY = V.Industry({"west": ["en", "fr"]}, {"academic": ["de", "es"]}, {"T1": 60, "T2": 76}, frozenset({"roles"}))
SEEN = f"SELECT *, CASE WHEN public THEN 'public' ELSE 'withdrawn' END AS visibility, posted + INTERVAL 2 HOUR AS visible_after, id % 7 <> 2 AS eligible, id % 13 = 0 AND NOT selected AS promotion, CASE WHEN id % 3 = 0 THEN 'x' ELSE 'news' END AS channel FROM ({PUB})"


def seen(spark, d):
    p = publications(spark, d)
    return p.select(
        "*", F.when(F.col("public"), "public").otherwise("withdrawn").alias("visibility"), (F.col("at") + F.expr("INTERVAL 2 HOURS")).alias("visible_after"), (F.col("id") % 7 != 2).alias("eligible"),
        ((F.col("id") % 13 == 0) & ~F.col("selected")).alias("promotion"), F.when(F.col("id") % 3 == 0, "x").otherwise("news").alias("channel"))


@add("f02_exported_pool", f"SELECT id FROM ({SEEN}) WHERE visibility = 'public' AND (NOT selected OR visible_after <= {AT}) AND eligible AND NOT promotion")
def f02(spark, d):
    return seen(spark, d).where(V.exported(at())).select("id")


@add("f03_selected_now", f"SELECT id FROM ({SEEN}) WHERE visibility = 'public' AND selected AND visible_after <= {AT}")
def f03(spark, d):
    return seen(spark, d).where(V.selected(at())).select("id")


@add("f04_channels", f"SELECT 'x' AS scope, id FROM ({SEEN}) WHERE channel = 'x' UNION ALL SELECT 'firstParty', id FROM ({SEEN}) WHERE first_party UNION ALL SELECT 'all', id FROM ({SEEN})")
def f04(spark, d):
    rows = seen(spark, d)
    part = lambda c: rows.where(V.in_channel(c)).select(F.lit(c).alias("scope"), "id")
    return part("x").unionByName(part("firstParty")).unionByName(part("all"))


@add("f05_category_members", f"SELECT id FROM ({SEEN}) WHERE category IN ('en', 'fr')")
def f05(spark, d):
    return seen(spark, d).where(V.in_category(INDUSTRY, "west")).select("id")


@add("f06_track_region", f"SELECT id FROM ({SEEN}) WHERE category IN ('de', 'es') AND source IN (SELECT source FROM documents GROUP BY source HAVING length(source) % 2 = 0)")
def f06(spark, d):
    (docs,) = load(spark, d, "documents")
    sources = docs.select("source", F.when(F.length("source") % 2 == 0, "domestic").otherwise("other").alias("region")).distinct()
    return V.of_region(seen(spark, d).where(V.in_track(INDUSTRY, "academic")), sources, "domestic").select("id")


@add("f10_public_match", "SELECT doc_id AS id FROM documents WHERE (contains(lower(coalesce(left(text, 60), '')), 'ation') OR doc_id % 3 > 0 AND contains(lower(coalesce(text, '')), 'ation')) AND (contains(lower(coalesce(left(text, 60), '')), 'th') OR doc_id % 3 > 0 AND contains(lower(coalesce(text, '')), 'th')) AND (contains(lower(coalesce(left(text, 60), '')), 'reading') OR doc_id % 3 > 0 AND contains(lower(coalesce(text, '')), 'reading'))")
def f10(spark, d):
    """Titles, and a table that has the bodies of two documents in three, searched by its index."""
    (docs,) = load(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("id"), F.lower(F.substring("text", 1, 60)).alias("direct"))
    bodies = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    index = SE.build(bodies, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}")
    return SE.public_match(items, F.col("direct"), index, bodies, ["ation", "th", "Reading"]).select("id")


@add("f11_rolling_window", f"SELECT id, posted >= {AT} - INTERVAL 24 HOUR AS within_day FROM ({SEEN}) WHERE posted BETWEEN {AT} - INTERVAL 7 DAY AND {AT}")
def f11(spark, d):
    rows = seen(spark, d).where(V.in_window(F.col("at"), "7d", at()))
    return rows.select("id", V.in_window(F.col("at"), "24h", at()).alias("within_day"))


@add("f12_pool_eligible", f"SELECT id, source <> 'src1' AND id % 5 <> 1 AND title <> '' AND id % 9 <> 0 AND (id % 2 = 0 OR score >= 40) AS eligible FROM ({SEEN})")
def f12(spark, d):
    mode = F.when(F.col("source") != "src1", "editorial").otherwise("hot_signal")
    ok = P.pool_eligible(mode, F.when(F.col("id") % 5 != 1, "pass"), F.col("title"), F.when(F.col("id") % 9 != 0, "summary"), F.col("score"), F.when(F.col("id") % 2 != 0, 40))
    return seen(spark, d).select("id", ok.alias("eligible"))


@add("f13_display_rules", f"""SELECT id, CASE WHEN id % 2 = 0 AND id % 3 <> 0 AND length(title) > 5 THEN 'full' ELSE 'summary' END AS body_mode, id % 4 = 0 AND id % 3 <> 0 AND length(title) > 5 AS redistribute,
public AND title <> '' AND id % 17 <> 0 AND (selected OR id % 10 = 0) AS indexable, public AND source <> 'src1' AS has_page, eligible AND selected AND id % 6 <> 0 AND NOT promotion AS selectable FROM ({SEEN})""")
def f13(spark, d):
    i = F.col("id")
    mode = V.body_mode(i % 2 == 0, F.when(i % 3 != 0, "ok").otherwise("failed"), F.length("title") > 5)
    moment = lambda cond: F.when(cond, at())
    return seen(spark, d).select(
        "id", mode.alias("body_mode"), V.redistributable(i % 4 == 0, mode).alias("redistribute"), V.indexable(F.col("visibility"), F.col("title") != "", F.col("selected"), moment(i % 10 == 0), moment(i % 17 == 0)).alias("indexable"),
        V.has_page(F.col("visibility"), F.when(F.col("source") != "src1", "editorial").otherwise("hot_signal")).alias("has_page"),
        P.selectable(F.col("eligible"), F.col("selected"), F.when(i % 6 == 0, "EXCLUDE_MP").otherwise("T1"), F.col("promotion")).alias("selectable"))


@add("f21_minimal_payload", f"""SELECT id, '{{"id":' || id || ',"title":"t' || id || '","links":{{"site":"/items/' || id || '"}}}}' AS payload FROM ({PUB})""")
def f21(spark, d):
    i = F.col("id").cast("string")
    links = F.struct(F.concat(F.lit("/items/"), i).alias("site"), F.concat(F.lit("https://example.org/"), i).alias("original"))
    wide = F.struct("id", F.concat(F.lit("t"), i).alias("title"), F.col("text").alias("original_title"), F.col("text").alias("summary"), F.lit("r").alias("reason"), F.lit("a").alias("attribution"), links.alias("links"))
    return publications(spark, d).select("id", F.to_json(V.minimal(wide)).alias("payload"))


@add("r11_sweep", f"""SELECT id FROM ({PUB}) WHERE id % 4 = 1 AND posted < {AT} - INTERVAL 3 MINUTE AND (id % 3 <> 0 OR posted + INTERVAL 1 DAY <= {AT}) AND (id % 5 <> 0 OR posted < {AT} - INTERVAL 6 HOUR) AND id % 7 <> 0 ORDER BY posted DESC, id LIMIT 500""")
def r11(spark, d):
    i, posted = F.col("id"), F.col("at")
    rows = publications(spark, d).select("id", F.when(i % 4 == 1, "new").otherwise("done").alias("state"), posted.alias("created"), posted.alias("discovered"), F.when(i % 3 == 0, posted + F.expr("INTERVAL 1 DAY")).alias("retry_at"), F.when(i % 5 == 0, posted).alias("queued_at"))
    jobs = rows.where("id % 7 = 0").select(F.col("id").alias("key"), F.lit("active").alias("state")).unionByName(rows.where("id % 11 = 0").select(F.col("id").alias("key"), F.lit("completed").alias("state")))
    return V.unheld(rows, jobs, at())


@add("r13_epoch_cursors", "SELECT c_custkey AS reader, CASE WHEN c_custkey % 3 = 0 THEN 'changes' ELSE 'snapshot' END AS answer, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10 END AS seq FROM customer")
def r13(spark, d):
    (c,) = load(spark, d, "customer")
    k = F.col("c_custkey")
    cursor = F.when(k % 3 == 0, F.concat(F.lit("e2."), (k * 10).cast("string"))).when(k % 3 == 1, F.concat(F.lit("e1."), k.cast("string"))).otherwise("e2.x")
    return V.since_epoch(c.select(k.alias("reader"), cursor.alias("cursor")), "e2")


@add("k07_agent_lines", f"""SELECT id, nth || '. [' || replace(replace(title, '[', '\\['), ']', '\\]') || '](/items/' || id || ')' || chr(10) || '   ' || source || ' · ' || strftime(posted + INTERVAL 8 HOUR, '%m-%d %H:%M') || ' · ' || category AS lines FROM
(SELECT *, row_number() OVER (ORDER BY posted DESC, id) AS nth FROM ({PUB}) WHERE selected AND category IS NOT NULL AND title IS NOT NULL ORDER BY posted DESC, id LIMIT 30)""")
def k07(spark, d):
    top = publications(spark, d).where("selected and category is not null and title is not null")
    return K.agent_lines(top, [F.col("at").desc(), F.col("id")], 30).select("id", "lines")


@add("k07_page_list", """WITH e AS (SELECT r_name AS section, r_regionkey AS s, n_nationkey AS n, '- [' || n_name || '](/nation/' || n_nationkey || ')' || CASE WHEN n_nationkey % 2 = 0 THEN ': Suppliers of ' || n_name ELSE '' END AS line FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)),
t AS (SELECT s, '## ' || section || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n) AS text FROM e GROUP BY s, section)
SELECT '# Nations' || chr(10) || chr(10) || '> Where suppliers are' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY s) || chr(10) AS value FROM t""")
def k07_pages(spark, d):
    """Nations as pages, listed if they need nothing or have a supplier in credit."""
    n, r, s = load(spark, d, "nation", "region", "supplier")
    key = F.col("n_nationkey")
    entries = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("section"), F.col("r_regionkey").alias("section_nth"), key.alias("nth"), F.col("n_name").alias("title"), F.concat(F.lit("/nation/"), key.cast("string")).alias("url"), F.when(key % 2 == 0, F.concat(F.lit("Suppliers of "), F.col("n_name"))).alias("note"), F.when(key % 3 != 0, key.cast("string")).alias("needs"))
    return K.page_list(entries, s.where("s_acctbal > 0").select(F.col("s_nationkey").cast("string").alias("kind")), "Nations", "Where suppliers are")


@add("e05_template_csv", "SELECT p_brand AS source, 'm' || p_partkey AS model, round(p_retailprice, 2) AS score FROM part WHERE p_partkey % 6 <> 0")
def e05(spark, d):
    (p,) = load(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("*m"), k, F.lit(",x,"), F.when(F.col("p_partkey") % 6 == 0, "n/a").otherwise(F.round("p_retailprice", 2).cast("string")))
    body = F.concat(F.lit("const a = `other`;\nconst d = `\nmodel_name,note,overall\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n`;"))
    # A body holds a block of parts, so bodies grow in number with the table and not in size.
    return B.template_csv(p.groupBy(F.col("p_brand").alias("source"), F.floor(F.col("p_partkey") / 500)).agg(body.alias("body")), "model_name", "overall")


@add("e08_edition", "SELECT 'm' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '-contributor' ELSE '' END || '@v1' AS model, p_size / 50.0 AS score, p_size / 50.0 - 0.01 AS low, p_size / 50.0 + 0.01 AS high, p_partkey % 4 <> 0 AS eligible FROM part WHERE p_size % 2 = 1")
def e08(spark, d):
    (p,) = load(spark, d, "part")
    rate = F.col("p_size") / 50.0
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "-contributor").otherwise(""), F.lit("@v1"))
    row = F.struct(name.alias("model"), F.struct(rate.alias("rate"), F.array(rate - 0.01, rate + 0.01).alias("ci95")).alias("l2"))
    editions = p.groupBy((F.col("p_size") % 2).cast("string").alias("id"), F.floor(F.col("p_partkey") / 500)).agg(F.to_json(F.struct(F.collect_list(row).alias("main_board"))).alias("body"))
    return B.newest_edition(spark.createDataFrame([('{"latest": "1"}',)], "body string"), editions)


@add("e09_submissions", "SELECT 'm' || p_partkey AS model, p_size / 100.0 AS score, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_size - 2) / 100.0 END AS low, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_size + 2) / 100.0 END AS high, false AS eligible FROM part WHERE p_partkey % 5 <> 0")
def e09(spark, d):
    (p,) = load(spark, d, "part")
    k = F.col("p_partkey")
    metrics = F.struct(F.when(k % 5 != 0, F.col("p_size").cast("double")).alias("accuracy"), F.when(k % 3 != 0, F.lit(2.0)).alias("accuracy_ci95_half_width"))
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("org/m"), k.cast("string")).alias("model_name")).alias("source_filter"), metrics.alias("metrics")))
    return B.submissions(p.select(F.concat(k.cast("string"), F.lit(".json")).alias("path"), body.alias("body")))


@add("e10_island_results", "SELECT p_brand AS source, 'm' || p_partkey AS model, p_size / 50.0 AS score FROM part")
def e10(spark, d):
    (p,) = load(spark, d, "part")
    one = F.concat(F.lit('"m'), F.col("p_partkey").cast("string"), F.lit('":[0,{"accuracy":[0,'), (F.col("p_size") / 50.0).cast("string"), F.lit("]}]"))
    json = F.concat(F.lit('{"view":[0,{"tasks":[0,{"overall":[0,{'), F.array_join(F.collect_list(one), ","), F.lit("}]}]}]}"))
    page = F.concat(F.lit('<p>x</p><astro-island component-url="/Nav.js" props="{}"></astro-island><astro-island uid="1" component-url="/_astro/BoardView.abc.js" props="'), F.replace(json, F.lit('"'), F.lit("&quot;")), F.lit('"></astro-island>'))
    return B.island_results(p.groupBy(F.col("p_brand").alias("source"), F.floor(F.col("p_partkey") / 500)).agg(page.alias("html")), "BoardView", "view")


@add("x02_thresholds", f"SELECT id, score >= CASE WHEN id % 2 = 0 THEN 60 ELSE 76 END AS passes FROM ({PUB})")
def x02(spark, d):
    tier = F.when(F.col("id") % 2 == 0, "T1").otherwise("T2")
    return publications(spark, d).select("id", (F.col("score") >= INDUSTRY.threshold(tier)).alias("passes"))


@add("t24_display_tags", "SELECT doc_id, list_filter(['cat:' || coalesce(lang, 'none'), 'entity:' || coalesce(source, 'none'), 'topic:news'], lambda t: NOT starts_with(t, 'entity:') AND (doc_id % 2 = 0 OR t <> 'topic:news')) AS tags FROM documents")
def t24(spark, d):
    (docs,) = load(spark, d, "documents")
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), F.coalesce(c, F.lit("none")))
    every = F.array_compact(F.array(tag("cat", F.col("lang")), tag("entity", F.col("source")), F.when(F.col("doc_id") % 2 == 0, F.lit("topic:news"))))
    return docs.select("doc_id", TX.display_tags(every).alias("tags"))


@add("m08_role_scores", "SELECT p_partkey, p_partkey % 5 + p_size % 5 + p_partkey % 3 + 3 * (p_size % 3) AS judged, round(2 * (p_size / 100.0) + p_partkey % 10 / 20.0, 9) AS expected FROM part")
def m08(spark, d):
    (p,) = load(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.select("p_partkey", M.role_score(k % 5, size % 5, k % 3, size % 3).alias("judged"), F.round(M.expected_role_score(size / 100.0, k % 10 / 20.0), 9).alias("expected"))


@add("r12_overflow", """WITH n AS (SELECT DISTINCT user_id, event_id // 7 AS item FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_id // 7 AS item FROM events WHERE event_id % 2 = 1 AND user_id % 3 > 0)
SELECT n.user_id, count(*) AS n, count(b.item) AS known, count(*) >= 5 AND count(b.item) = 0 AS overflow FROM n LEFT JOIN b ON b.user_id = n.user_id AND b.item = n.item GROUP BY 1""")
def r12(spark, d):
    (e,) = load(spark, d, "events")
    rows = e.select("event_id", "user_id", F.floor(F.col("event_id") / 7).alias("item"))
    return LI.overflowed(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1 and user_id % 3 > 0"), "item", by="user_id")


@add("r12_first_import", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY posted DESC NULLS LAST) AS n FROM (SELECT doc_id, source, CASE WHEN doc_id % 10 > 0 THEN TIMESTAMP '2024-01-20' - to_days(CAST(doc_id AS INTEGER)) END AS posted FROM documents) WHERE posted IS NULL OR posted >= TIMESTAMP '2023-07-20') WHERE n <= 5 AND posted IS NOT NULL")
def r12_first(spark, d):
    (docs,) = load(spark, d, "documents")
    at = F.when(F.col("doc_id") % 10 > 0, ts("2024-01-20") - F.make_interval(days=F.col("doc_id").cast("int")))
    rows = docs.select("doc_id", "source", at.alias("at"))
    return LI.first_import(rows, "at", ts("2024-01-20"), 5, 6, "source").where("at is not null").select("doc_id", "source")


@add("x01_source_issues", """SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'no source is of kind ' || event_type WHEN event_id % 4 = 0 THEN CASE event_type WHEN 'click' THEN 'rss' ELSE 'push' END || ' has no key items' WHEN event_type = 'view' THEN 'push has no key url' END AS issue FROM events""")
def x01(spark, d):
    (e,) = load(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "rss").when(F.col("event_type") == "view", "push").otherwise(F.col("event_type"))
    keys = F.array_compact(F.array(F.when(~((F.col("event_type") == "view") & (F.col("event_id") % 4 == 0)), F.lit("url")), F.when(F.col("event_id") % 4 == 0, F.lit("items"))))
    return e.select("event_id", V.source_issue(kind, keys).alias("issue"))


@add("x03_features", "SELECT count(*) AS n, true AS with_roles, false AS with_podcasts FROM documents WHERE lang IN ('en', 'fr')")
def x03(spark, d):
    """A part of the plan that a feature switches on, and one that stays off."""
    (docs,) = load(spark, d, "documents")
    field = V.Industry(features=frozenset({"roles"}))
    rows = docs.where(F.col("lang").isin("en", "fr")) if field.on("roles") else docs
    rows = rows.where("source = 'podcast'") if field.on("podcasts") else rows
    return rows.agg(F.count("*").alias("n")).select("n", F.lit(field.on("roles")).alias("with_roles"), F.lit(field.on("podcasts")).alias("with_podcasts"))


@add("e01_pinned_board", "SELECT model, 'text/overall' AS board, score, score - 5 AS low, score + 5 AS high, rank() OVER (ORDER BY score DESC) AS place FROM (SELECT 'm' || p_partkey AS model, CAST(p_size AS DOUBLE) AS score FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 7 > 0)")
def e01(spark, d):
    """A data set of two revisions and configurations, written from parts, read at one of them."""
    (p,) = load(spark, d, "part")
    root = f"{shared_folder(spark)}/boards-{uuid.uuid4().hex}"
    rating = F.when(F.col("p_partkey") % 7 > 0, F.col("p_size").cast("double"))
    rows = p.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model_name"), F.when(F.col("p_partkey") % 2 == 0, "overall").otherwise("coding").alias("category"), rating.alias("rating"), (rating - 5).alias("rating_lower"), (rating + 5).alias("rating_upper"))
    rows.write.parquet(f"{root}/rev2/text")
    rows.withColumn("rating", F.lit(0.0)).write.parquet(f"{root}/rev1/text")
    return B.pinned_board(spark, root, "rev2", "text", "overall")


@add("e02_paged_board", """SELECT p_brand AS source, 'm-' || p_partkey AS model, p_size / 10.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= CASE WHEN p_brand LIKE '%1' THEN 20 ELSE 200 END AND p_partkey % 9 > 0""")
def e02(spark, d):
    """Pages of ten parts a brand; one brand in a few says after two pages that there are no more."""
    (p,) = load(spark, d, "part")
    nth = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    row = F.struct(F.concat(F.lit("M. "), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_size") / 10.0).alias("score"))
    pages = p.withColumn("page", F.ceil(nth / 10).cast("int")).groupBy(F.col("p_brand").alias("source"), "page").agg(F.collect_list(row).alias("data"))
    more = ~(F.endswith("source", F.lit("1")) & (F.col("page") >= 2))
    bodies = pages.select("source", "page", F.to_json(F.struct("data", more.alias("has_more"))).alias("body"))
    return B.board_rows("paged_json", {"most": 20}, bodies)


@add("e03_harness_board", """SELECT p_brand AS source, 'm' || p_size AS model, CASE WHEN p_partkey % 2 = 0 THEN 'high+' ELSE '' END || 'harness-agent-' || p_partkey % 3 AS configuration, p_retailprice / 10000 AS score, p_retailprice / 10000 - 0.01 AS low, p_retailprice / 10000 + 0.01 AS high, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS place FROM part""")
def e03(spark, d):
    (p,) = load(spark, d, "part")
    rate = F.col("p_retailprice").cast("double") / 10000
    row = F.struct(F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("model"), F.concat(F.lit("Agent ("), (F.col("p_partkey") % 3).cast("string"), F.lit(")")).alias("harness"), F.when(F.col("p_partkey") % 2 == 0, "High").alias("reasoning_effort"), rate.alias("pass_rate"), (rate - 0.01).alias("ci_lo"), (rate + 0.01).alias("ci_hi"))
    # A body holds fifty rows; a board's rows are put together from all of its bodies.
    bodies = p.groupBy(F.col("p_brand").alias("source"), F.floor(F.col("p_partkey") / 50)).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("body"))
    return B.harness_board(bodies)


@add("s20_csv_bodies", """SELECT doc_id, coalesce(source, '') AS source, replace(coalesce(text, ''), chr(0), '') AS text FROM documents""")
def s20(spark, d):
    """Every document as a record of a CSV body, twenty a body, with quotes and line breaks kept."""
    (docs,) = load(spark, d, "documents")
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit("\x00"), F.lit("")), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), cell(F.col("source")), cell(F.col("text")))
    bodies = docs.groupBy(F.floor(F.col("doc_id") / 20).cast("string").alias("path")).agg(F.concat(F.lit("doc_id,source,text\n"), F.array_join(F.collect_list(line), "\n")).alias("body"))
    return B.plain_csv(bodies).select(F.col("record")["doc_id"].cast("long").alias("doc_id"), F.col("record")["source"].alias("source"), F.col("record")["text"].alias("text"))
