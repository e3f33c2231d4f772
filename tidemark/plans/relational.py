"""Joins, aggregates, windows, top-k, pages and set operations on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.plans.registry import Registry
from tidemark.session import table

REGISTRY = Registry()
add = REGISTRY.add


def load(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# Joins


@add("j01_inner_star", """SELECT n_name, r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def j01(spark, d):
    o, c, n, r = load(spark, d, "orders", "customer", "nation", "region")
    star = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return star.groupBy("n_name", "r_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@add("j02_left_theta", """SELECT c_custkey, count(o_orderkey) AS n_large FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND o_orderstatus = 'O' GROUP BY c_custkey""")
def j02(spark, d):
    c, o = load(spark, d, "customer", "orders")
    on = (o.o_custkey == c.c_custkey) & (o.o_totalprice > 200000) & (o.o_orderstatus == "O")
    return c.join(o, on, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_large"))


@add("j03_join_on_extracted_key", """SELECT e.event_id, p.p_name FROM events e
LEFT JOIN part p ON CAST(nullif(regexp_extract(e.props, '"k": ([0-9]+)', 1), '') AS BIGINT) = p.p_partkey""")
def j03(spark, d):
    e, p = load(spark, d, "events", "part")
    key = F.nullif(F.regexp_extract("props", r'"k": ([0-9]+)', 1), F.lit("")).cast("long")
    return e.withColumn("k", key).join(p, F.col("k") == p.p_partkey, "left").select("event_id", "p_name")


@add("j04_lateral_latest", """SELECT c_custkey, o_orderkey, o_orderdate FROM customer, LATERAL
(SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
def j04(spark, d):
    c, o = load(spark, d, "customer", "orders")
    last = R.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])
    return c.join(last, c.c_custkey == last.o_custkey).select("c_custkey", "o_orderkey", "o_orderdate")


@add("j05_unnest", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word""")
def j05(spark, d):
    (p,) = load(spark, d, "part")
    return p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@add("j06_scalar_default", """SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), m.p) AS priority FROM orders
CROSS JOIN (SELECT max(o_orderpriority) AS p FROM orders) m""")
def j06(spark, d):
    (o,) = load(spark, d, "orders")
    most = o.agg(F.max("o_orderpriority").alias("p"))
    return o.crossJoin(F.broadcast(most)).select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("1-URGENT")), "p").alias("priority"))


@add("j07_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j07(spark, d):
    c, o = load(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@add("j08_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j08(spark, d):
    c, o = load(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@add("j09_not_in_filter", """WITH c AS (SELECT max(ts) - INTERVAL 5 DAY AS t0 FROM events)
SELECT event_type, count(DISTINCT user_id) AS n_new FROM events e, c WHERE ts > t0 AND NOT EXISTS
(SELECT 1 FROM events p WHERE p.event_type = e.event_type AND p.user_id = e.user_id AND p.ts <= t0) GROUP BY event_type""")
def j09(spark, d):
    (e,) = load(spark, d, "events")
    dated = e.crossJoin(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("at"))))
    per = dated.groupBy("event_type", "user_id").agg(F.bool_or(F.col("ts") <= F.col("at")).alias("old"))
    return per.where(~F.col("old")).groupBy("event_type").agg(F.count("*").alias("n_new"))


@add("j10_full", """SELECT coalesce(a.k, b.k) AS k, a.n AS n_orders, b.n AS n_suppliers FROM
(SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN
(SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def j10(spark, d):
    c, s = load(spark, d, "customer", "supplier")
    a = c.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_orders"))
    b = s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full").select("k", "n_orders", "n_suppliers")


@add("j11_or_join", """SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer
ON s_nationkey = c_nationkey AND s_suppkey % 50 = c_custkey % 50 OR s_suppkey = c_custkey""")
def j11(spark, d):
    s, c = load(spark, d, "supplier", "customer")
    left = s.withColumn("a", F.struct("s_nationkey", (F.col("s_suppkey") % 50).alias("m")))
    right = c.withColumn("b", F.struct(F.col("c_nationkey").alias("s_nationkey"), (F.col("c_custkey") % 50).alias("m"))).withColumn("own", F.col("c_custkey"))
    return R.any_key(left, right, [("a", "b"), ("s_suppkey", "own")], "s_suppkey", "c_custkey")


@add("j12_left_time_range", """SELECT o.o_orderkey, count(l.l_orderkey) AS n_soon FROM orders o LEFT JOIN lineitem l
ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL 30 DAY GROUP BY o.o_orderkey""")
def j12(spark, d):
    o, li = load(spark, d, "orders", "lineitem")
    on = (li.l_orderkey == o.o_orderkey) & (li.l_shipdate >= o.o_orderdate) & (li.l_shipdate < o.o_orderdate + F.expr("INTERVAL 30 DAYS"))
    return o.join(li, on, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_soon"))


@add("j13_self_pairs", """SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(DISTINCT a.l_orderkey) >= 15""")
def j13(spark, d):
    (li,) = load(spark, d, "lineitem")
    return R.pair_counts(li, "l_orderkey", "l_suppkey", 15)


@add("j14_dense_grid", """SELECT n_name, o_orderstatus, coalesce(n, 0) AS n FROM (SELECT n_name, n_nationkey FROM nation)
CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) LEFT JOIN (SELECT c_nationkey AS k, o_orderstatus AS s, count(*) AS n FROM orders
JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY ALL) ON k = n_nationkey AND s = o_orderstatus""")
def j14(spark, d):
    n, o, c = load(spark, d, "nation", "orders", "customer")
    facts = o.where("o_totalprice > 400000").join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("n_nationkey"), "o_orderstatus").agg(F.count("*").alias("n"))
    grid = R.dense_grid(n.select("n_name", "n_nationkey"), o.select("o_orderstatus").distinct(), facts, ["n_nationkey", "o_orderstatus"], ["n"])
    return grid.select("n_name", "o_orderstatus", "n")


@add("j16_any_key_first", """WITH p AS (SELECT p_partkey, p_name, p_brand || p_type AS kind FROM part),
m AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_partkey <> b.p_partkey AND (a.p_name = b.p_name OR a.kind = b.kind))
SELECT a AS p_partkey, min(b) AS first_match, count(*) AS n_matches FROM m GROUP BY a""")
def j16(spark, d):
    (p,) = load(spark, d, "part")
    keyed = p.select("p_partkey", "p_name", F.concat("p_brand", "p_type").alias("kind"))
    return R.any_key_first(keyed, "p_partkey", ["p_name", "kind"])


@add("j18_as_of", """SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN
(SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def j18(spark, d):
    (e,) = load(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("event_id").alias("purchase_id"))
    return R.as_of(e.select("event_id", "user_id", "ts"), bought, "user_id", "ts").select("event_id", "purchase_id")


@add("j19_carry_forward", """WITH c AS (SELECT o_custkey, o_orderdate, o_orderkey, date_trunc('month', o_orderdate) AS m FROM orders),
l AS (SELECT max(m) AS m FROM c), newest AS (SELECT o_custkey, max(o_orderdate) AS seen FROM c, l WHERE c.m = l.m GROUP BY 1),
older AS (SELECT o_custkey, max(o_orderdate) AS seen FROM c, l WHERE c.m < l.m AND o_orderdate >= l.m - INTERVAL 60 DAY GROUP BY 1)
SELECT * FROM newest UNION ALL SELECT * FROM older WHERE o_custkey NOT IN (SELECT o_custkey FROM newest)""")
def j19(spark, d):
    (o,) = load(spark, d, "orders")
    dated = o.select("o_custkey", F.col("o_orderdate").alias("seen"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m"))
    dated = dated.crossJoin(F.broadcast(dated.agg(F.max("m").alias("at"))))
    newest = dated.where("m = at").groupBy("o_custkey", "at").agg(F.max("seen").alias("seen"))
    return R.carry_forward(newest, dated.where("m < at").select("o_custkey", "at", "seen"), ["o_custkey"], "seen", F.col("at"), 60).select("o_custkey", "seen")


@add("j20_alias_resolution", """WITH names AS (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM supplier),
alias AS (SELECT s_suppkey AS target, s_name AS alias FROM supplier WHERE s_suppkey % 3 = 0), raw AS (SELECT DISTINCT s_name AS name FROM supplier)
SELECT name, coalesce(a.target, n.s_suppkey) AS model, CASE WHEN a.target IS NOT NULL THEN 'alias' WHEN n.s_suppkey IS NOT NULL THEN 'slug' ELSE 'new' END AS how
FROM raw LEFT JOIN alias a ON a.alias = name LEFT JOIN (SELECT * FROM names WHERE s_suppkey % 2 = 0) n ON n.slug = lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g'))""")
def j20(spark, d):
    (s,) = load(spark, d, "supplier")
    slug = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"))
    alias = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("target"), F.col("s_name").alias("name"))
    slugs = s.where("s_suppkey % 2 = 0").select("s_suppkey", slug("s_name").alias("slug"))
    raw = s.select(F.col("s_name").alias("name")).distinct().withColumn("slug", slug("name"))
    how = F.when(F.col("target").isNotNull(), "alias").when(F.col("s_suppkey").isNotNull(), "slug").otherwise("new")
    return raw.join(alias, "name", "left").join(slugs, "slug", "left").select("name", F.coalesce("target", "s_suppkey").alias("model"), how.alias("how"))


@add("j21_merge_chain", """WITH RECURSIVE link AS (SELECT p_partkey AS s, CAST(floor(p_partkey / 2) AS BIGINT) AS t FROM part WHERE p_partkey > 1),
walk AS (SELECT s, t, 1 AS hops FROM link UNION ALL SELECT w.s, l.t, hops + 1 FROM walk w JOIN link l ON w.t = l.s)
SELECT s AS p_partkey, t AS survivor, hops FROM walk WHERE t NOT IN (SELECT s FROM link)""")
def j21(spark, d):
    (p,) = load(spark, d, "part")
    links = p.where("p_partkey > 1").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("into"))
    return R.survivors(links, "p_partkey", "into")


@add("j22_redirect_duplicates", """SELECT coalesce(dup, p_partkey) AS item, count(*) AS n, min(p_retailprice) AS least FROM
(SELECT *, CASE WHEN p_partkey % 10 = 7 THEN p_partkey - 1 END AS dup FROM part) GROUP BY 1""")
def j22(spark, d):
    (p,) = load(spark, d, "part")
    dup = F.when(F.col("p_partkey") % 10 == 7, F.col("p_partkey") - 1)
    return p.groupBy(F.coalesce(dup, "p_partkey").alias("item")).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("least"))


@add("j23_update_from", """SELECT c_custkey, CASE WHEN n_name IS NOT NULL AND c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey""")
def j23(spark, d):
    c, n = load(spark, d, "customer", "nation")
    hit = n.where("n_regionkey = 1").select("n_nationkey", "n_name")
    value = F.when(F.col("n_name").isNotNull() & (F.col("c_acctbal") < 0), F.lit(0.0)).otherwise(F.col("c_acctbal"))
    return c.join(hit, c.c_nationkey == hit.n_nationkey, "left").select("c_custkey", value.alias("c_acctbal"))


# Aggregations


@add("g01_two_level", """SELECT event_type, count(*) AS n_users, round(sum(m), 4) AS total, max(n) AS most FROM
(SELECT event_type, user_id, max(value) AS m, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""")
def g01(spark, d):
    (e,) = load(spark, d, "events")
    per = e.groupBy("event_type", "user_id").agg(F.max("value").alias("m"), F.count("*").alias("n"))
    return per.groupBy("event_type").agg(F.count("*").alias("n_users"), F.round(F.sum("m"), 4).alias("total"), F.max("n").alias("most"))


@add("g02_filtered_aggregates", """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, min(l_shipdate) FILTER (WHERE l_linestatus = 'O') AS first_open,
bool_or(l_discount > 0.09) AS deep, round(sum(l_quantity) FILTER (WHERE l_tax > 0.05), 2) AS taxed FROM lineitem GROUP BY l_suppkey""")
def g02(spark, d):
    (li,) = load(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.min(F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))).alias("first_open"),
        F.bool_or(F.col("l_discount") > 0.09).alias("deep"), F.round(F.sum(F.when(F.col("l_tax") > 0.05, F.col("l_quantity"))), 2).alias("taxed"))


@add("g03_having", """SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled FROM orders
GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F') >= 3 AND count(DISTINCT o_orderpriority) >= 3 AND bool_or(o_totalprice > 300000)""")
def g03(spark, d):
    (o,) = load(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n_priorities"), F.count_if(F.col("o_orderstatus") == "F").alias("n_filled"), F.bool_or(F.col("o_totalprice") > 300000).alias("b")).where("n_filled >= 3 and n_priorities >= 3 and b").drop("b")


@add("g04_distinct_counts", """SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT user_id) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY 1""")
def g04(spark, d):
    (e,) = load(spark, d, "events")
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("n_high"))


@add("g05_percentile_disc", """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def g05(spark, d):
    (e,) = load(spark, d, "events")
    return e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@add("g06_percentile_cont", """SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5) FILTER (WHERE l_tax > 0.02), 4) AS median FROM lineitem GROUP BY 1""")
def g06(spark, d):
    (li,) = load(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.percentile(F.when(F.col("l_tax") > 0.02, F.col("l_quantity")), 0.5), 4).alias("median"))


@add("g07_latest_value", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1""")
def g07(spark, d):
    (e,) = load(spark, d, "events")
    return R.latest(e, ["user_id"], ["ts", "event_id"], ["event_type", "value"]).withColumnsRenamed({"event_type": "last_type", "value": "last_value"})


@add("g08_string_agg_distinct", """SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1""")
def g08(spark, d):
    (n,) = load(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ", ").alias("names"))


@add("g09_nested_aggregates", """SELECT c_nationkey, to_json(list({'k': c_custkey, 'b': c_mktsegment} ORDER BY c_custkey)) AS rows_json FROM customer WHERE c_acctbal > 9000 GROUP BY 1""")
def g09(spark, d):
    (c,) = load(spark, d, "customer")
    rows = F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("b"))))
    return c.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.to_json(rows).alias("rows_json"))


@add("g10_counts_by_tag", """SELECT c_mktsegment, map_from_entries(list((s, n) ORDER BY s)) AS by_status FROM (SELECT c_mktsegment, o_orderstatus AS s, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1""".replace("map_from_entries(list((s, n) ORDER BY s))", "string_agg(s || '=' || n, ',' ORDER BY s)"))
def g10(spark, d):
    o, c = load(spark, d, "orders", "customer")
    n = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    return n.groupBy("c_mktsegment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "n"))), lambda x: F.concat(x["s"], F.lit("="), x["n"].cast("string"))), ",").alias("by_status"))


@add("g11_group_by_json_path", """SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS band, count(*) AS n FROM events GROUP BY ALL""")
def g11(spark, d):
    (e,) = load(spark, d, "events")
    return e.groupBy("event_type", F.floor(F.get_json_object("props", "$.k").cast("long") / 10).alias("band")).agg(F.count("*").alias("n"))


@add("g12_stats_bundle", """SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(DISTINCT source) FROM documents) AS n_sources, (SELECT count(*) FROM events WHERE event_type = 'view') AS n_views,
(SELECT max(ts) FROM events) AS last_event, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n_open""")
def g12(spark, d):
    docs, e, o = load(spark, d, "documents", "events", "orders")
    a = docs.agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"))
    b = e.agg(F.count_if(F.col("event_type") == "view").alias("n_views"), F.max("ts").alias("last_event"))
    return a.crossJoin(b).crossJoin(o.agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open")))


@add("g13_capped_count", "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem WHERE l_quantity > 10 LIMIT 2000)")
def g13(spark, d):
    (li,) = load(spark, d, "lineitem")
    return R.capped_count(li.where("l_quantity > 10").select("l_orderkey"), 2000)


@add("g14_array_average", """SELECT vec_id, round(list_avg(list_filter(embedding, lambda x: x > 0)), 5) AS positive_mean FROM embeddings""")
def g14(spark, d):
    (e,) = load(spark, d, "embeddings")
    up = F.filter("embedding", lambda x: x > 0)
    return e.select("vec_id", F.round(F.try_divide(F.aggregate(up, F.lit(0.0).cast("double"), lambda s, x: s + x), F.size(up)), 5).alias("positive_mean"))


@add("g15_pair_support", """SELECT least(a, b) AS a, greatest(a, b) AS b, count(DISTINCT k) AS n FROM (SELECT l_suppkey AS a, l_partkey % 100 AS b, l_orderkey AS k FROM lineitem)
WHERE a <> b GROUP BY 1, 2 HAVING count(DISTINCT k) >= 2""")
def g15(spark, d):
    (li,) = load(spark, d, "lineitem")
    x = li.select(F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 100).alias("y"), "l_orderkey").where("x <> y")
    return x.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count_distinct("l_orderkey").alias("n")).where("n >= 2")


@add("g16_modal_vote", """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1""")
def g16(spark, d):
    (e,) = load(spark, d, "events")
    votes = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.distinct_on(votes, ["user_id"], F.col("n").desc(), F.col("event_type"))


@add("g17_histogram_retention", """WITH h AS (SELECT CAST(least(greatest(floor(p_retailprice / 200) + 1, 0), 11) AS BIGINT) AS bucket FROM part)
SELECT 'bucket' AS what, bucket AS level, count(*) AS n FROM h GROUP BY ALL UNION ALL
SELECT 'kept', t, count(*) FILTER (WHERE p_size >= t) FROM part CROSS JOIN (SELECT unnest([10, 20, 30, 40]::BIGINT[]) AS t) GROUP BY t""")
def g17(spark, d):
    (p,) = load(spark, d, "part")
    hist = p.groupBy(F.width_bucket(F.col("p_retailprice"), F.lit(0.0), F.lit(2000.0), F.lit(10)).alias("level")).agg(F.count("*").alias("n")).select(F.lit("bucket").alias("what"), "level", "n")
    kept = p.select("p_size", F.explode(F.array(*[F.lit(t).cast("long") for t in (10, 20, 30, 40)])).alias("level")).groupBy("level").agg(F.count_if(F.col("p_size") >= F.col("level")).alias("n"))
    return hist.unionByName(kept.select(F.lit("kept").alias("what"), "level", "n"))


@add("g18_weekly_coverage", """WITH w AS (SELECT unnest(generate_series(date_trunc('week', (SELECT min(ts) FROM events)), date_trunc('week', (SELECT max(ts) FROM events)), INTERVAL 7 DAY)) AS week),
t AS (SELECT DISTINCT event_type FROM events) SELECT w.week, t.event_type, count(e.event_id) AS n, count(DISTINCT e.user_id) AS n_users FROM w CROSS JOIN t
LEFT JOIN events e ON date_trunc('week', e.ts) = w.week AND e.event_type = t.event_type AND e.value > 90 GROUP BY ALL""")
def g18(spark, d):
    (e,) = load(spark, d, "events")
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    span = e.agg(F.min(week).alias("a"), F.max(week).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    facts = e.where("value > 90").groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))
    return R.dense_grid(span, e.select("event_type").distinct(), facts, ["week", "event_type"], ["n", "n_users"])


@add("g19_total_row", """SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
UNION ALL SELECT 'all', count(*), round(sum(o_totalprice), 2) FROM orders""")
def g19(spark, d):
    (o,) = load(spark, d, "orders")
    both = o.rollup("o_orderstatus").agg(F.grouping("o_orderstatus").alias("g"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return both.select(F.when(F.col("g") == 1, "all").otherwise(F.col("o_orderstatus")).alias("status"), "n", "total")


@add("g22_presence_rates", """SELECT source, round(avg(CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS text_rate, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 6) AS long_rate FROM documents GROUP BY 1""")
def g22(spark, d):
    (docs,) = load(spark, d, "documents")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return docs.groupBy("source").agg(rate(F.col("text").isNotNull()).alias("text_rate"), rate(F.coalesce(F.col("n_chars") > 1000, F.lit(False))).alias("long_rate"))


@add("g23_coverage_samples", """SELECT user_id, count(DISTINCT event_type) AS n_types, count(*) AS n, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 3), ',') AS samples FROM events GROUP BY 1""")
def g23(spark, d):
    (e,) = load(spark, d, "events")
    # Only three ids a group are kept, each task's least ones first, so a large group stays small.
    firsts = R.first_of_each(e.select("user_id", "event_id"), ["user_id"], [F.col("event_id")], 3).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ",").alias("samples"))
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n_types"), F.count("*").alias("n")).join(firsts, "user_id")


@add("g24_cost_rollup", """SELECT p_brand, round(sum(l_quantity * p_retailprice), 2) AS cost, round(sum(l_quantity * p_retailprice) FILTER (WHERE l_discount >= 0.05), 2) AS discounted,
count(*) AS calls FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def g24(spark, d):
    li, p = load(spark, d, "lineitem", "part")
    cost = F.col("l_quantity") * F.col("p_retailprice")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand").agg(F.round(F.sum(cost), 2).alias("cost"), F.round(F.sum(F.when(F.col("l_discount") >= 0.05, cost)), 2).alias("discounted"), F.count("*").alias("calls"))


@add("g25_masked_groups", """SELECT regexp_replace(regexp_replace(p_name || ' at 0x' || md5(CAST(p_partkey AS VARCHAR)), '0x[0-9a-f]+', '…', 'g'), '[0-9]+', '…', 'g') AS message, count(*) AS n FROM part GROUP BY 1""")
def g25(spark, d):
    (p,) = load(spark, d, "part")
    message = F.concat("p_name", F.lit(" at 0x"), F.md5(F.col("p_partkey").cast("string")))
    return p.groupBy(F.regexp_replace(F.regexp_replace(message, "0x[0-9a-f]+", "…"), "[0-9]+", "…").alias("message")).agg(F.count("*").alias("n"))


@add("g26_budget_windows", """WITH c AS (SELECT max(ts) AS t0 FROM events) SELECT event_type, count(*) FILTER (WHERE ts > t0 - INTERVAL 1 MINUTE) AS per_minute, count(*) FILTER (WHERE ts > t0 - INTERVAL 1 HOUR) AS per_hour,
count(*) AS per_day, greatest(0, 3600 - CAST(round(epoch(t0 - min(ts) FILTER (WHERE ts > t0 - INTERVAL 1 HOUR))) AS BIGINT)) AS wait_s FROM events, c WHERE ts > t0 - INTERVAL 1 DAY GROUP BY event_type, t0""")
def g26(spark, d):
    (e,) = load(spark, d, "events")
    from tidemark.operators.usage import budgets

    return budgets(e, "event_type", "ts")


@add("g27_net_support", """WITH u AS (SELECT p_brand AS m, l_suppkey % 8 AS unit, avg(l_extendedprice) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT a.m AS a, b.m AS b, CAST(sum(sign(a.score - b.score)) AS DOUBLE) AS net, CAST(count(*) AS DOUBLE) AS weight, count(*) AS shared FROM u a JOIN u b ON a.unit = b.unit AND a.m < b.m GROUP BY ALL""")
def g27(spark, d):
    from tidemark.operators.consensus import net_support

    return net_support(unit_scores(spark, d), soft=False)


def unit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Part brands as models, suppliers modulo 8 as evaluation units, mean prices as scores."""
    li, p = load(spark, d, "lineitem", "part")
    priced = li.join(p, li.l_partkey == p.p_partkey)
    return priced.groupBy(F.col("p_brand").alias("model"), (F.col("l_suppkey") % 8).alias("unit")).agg(F.avg("l_extendedprice").alias("score")).withColumn("weight", F.lit(1.0))


@add("g28_grouping_sets", """SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def g28(spark, d):
    (li,) = load(spark, d, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


# Windows


@add("w01_lag_gaps", """SELECT user_id, day, CAST(day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS gap FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)""")
def w01(spark, d):
    (e,) = load(spark, d, "events")
    days = e.select("user_id", F.to_date("ts").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))).cast("long")
    return days.select("user_id", "day", gap.alias("gap"))


@add("w02_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def w02(spark, d):
    (o,) = load(spark, d, "orders")
    return R.distinct_on(o.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey"))


@add("w03_competition_rank", "SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place FROM part")
def w03(spark, d):
    (p,) = load(spark, d, "part")
    return p.select("p_partkey", "p_brand", "p_size", F.rank().over(Window.partitionBy("p_brand").orderBy(F.col("p_size").desc())).cast("long").alias("place"))


@add("w04_position", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def w04(spark, d):
    (p,) = load(spark, d, "part")
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")).cast("long").alias("place"))


@add("w05_neighbours", "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next_one FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w05(spark, d):
    (o,) = load(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next_one"))


@add("w06_min_of_others", """SELECT o.o_orderkey, min(x.o_totalprice) AS least_other FROM orders o LEFT JOIN orders x ON x.o_custkey = o.o_custkey AND x.o_orderkey <> o.o_orderkey GROUP BY 1""")
def w06(spark, d):
    (o,) = load(spark, d, "orders")
    own = o.select("o_custkey", "o_totalprice", "o_orderkey")
    # The two least of each customer are enough: all rows but the least one itself see the least.
    two = R.first_of_each(own.select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")], 2)
    low = two.groupBy("o_custkey").agg(F.min_by("o_orderkey", "place").alias("k1"), F.min("o_totalprice").alias("v1"), F.max(F.when(F.col("place") == 2, F.col("o_totalprice"))).alias("v2"))
    return own.join(low, "o_custkey").select("o_orderkey", F.when(F.col("o_orderkey") == F.col("k1"), F.col("v2")).otherwise(F.col("v1")).alias("least_other"))


@add("w07_root", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS root FROM orders GROUP BY 1")
def w07(spark, d):
    (o,) = load(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("root"))


@add("w08_reverse_sum", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS after FROM part")
def w08(spark, d):
    (p,) = load(spark, d, "part")
    return R.sum_from_here(p, "p_brand", "p_partkey", "p_size", "after").select("p_partkey", "after")


@add("w09_half_life", """SELECT event_type, round(sum(value * pow(0.5, epoch((SELECT max(ts) FROM events) - ts) / 3600.0 / 72)), 4) AS decayed FROM events GROUP BY 1""")
def w09(spark, d):
    from tidemark.functions.math import decay

    (e,) = load(spark, d, "events")
    at = e.agg(F.max("ts").alias("at"))
    return e.crossJoin(F.broadcast(at)).groupBy("event_type").agg(F.round(F.sum(F.col("value") * decay(F.col("at"), F.col("ts"), 72)), 4).alias("decayed"))


@add("w10_section_capacity", """WITH r AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n, p_partkey) AS m FROM r WHERE n > 8)
SELECT p_partkey, 'section' AS slot, n AS place FROM r WHERE n <= 8 UNION ALL SELECT p_partkey, 'flash', m FROM f WHERE m <= 12""")
def w10(spark, d):
    (p,) = load(spark, d, "part")
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    ranked = p.select("p_partkey", "p_brand", "p_type", n.cast("long").alias("n"))
    section = ranked.where("n <= 8").select("p_partkey", F.lit("section").alias("slot"), F.col("n").alias("place"))
    flash = R.first_of_each(ranked.where("n > 8"), ["p_type"], [F.col("n"), F.col("p_partkey")], 12)
    return section.unionByName(flash.select("p_partkey", F.lit("flash").alias("slot"), "place"))


@add("w11_quota_top", """WITH r AS (SELECT o_orderkey, o_orderpriority AS t, o_totalprice AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10 AS f FROM orders),
k AS (SELECT * FROM r ORDER BY f DESC, s DESC, o_orderkey LIMIT 40) SELECT o_orderkey, row_number() OVER (ORDER BY s DESC, o_orderkey) AS place FROM k""")
def w11(spark, d):
    (o,) = load(spark, d, "orders")
    return R.quota_top(o, "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40).select("o_orderkey", "place")


@add("w12_interleave", """WITH k AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders)
SELECT o_orderkey, nth, row_number() OVER (ORDER BY nth, o_orderstatus) AS place FROM k""")
def w12(spark, d):
    (o,) = load(spark, d, "orders")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return R.interleave(o.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", order).select("o_orderkey", "nth", "place")


@add("w13_median_interval", """SELECT event_type, round(median(g), 4) AS median_hours FROM (SELECT event_type, epoch(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) / 3600.0 AS g FROM events WHERE value > 60) GROUP BY 1""")
def w13(spark, d):
    (e,) = load(spark, d, "events")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(Window.partitionBy("event_type").orderBy("ts")), F.col("ts")) / 3.6e9
    return e.where("value > 60").select("event_type", gap.alias("g")).groupBy("event_type").agg(F.round(F.percentile("g", 0.5), 4).alias("median_hours"))


# Sorting, limits and pages


@add("l01_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 80")
def l01(spark, d):
    (o,) = load(spark, d, "orders")
    return R.offset_page(o.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@add("l02_late_materialisation", """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20)
SELECT doc_id, position, md5(text) AS text_md5, source FROM documents JOIN p USING (doc_id)""")
def l02(spark, d):
    (docs,) = load(spark, d, "documents")
    page = docs.select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").alias("b"))
    return R.hydrate(page, docs.select("doc_id", "text", "source"), "doc_id", order).select("doc_id", F.col("position").cast("long"), F.md5("text").alias("text_md5"), "source")


@add("l03_keyset_page", """SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01 00:00:00', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""")
def l03(spark, d):
    import datetime

    (o,) = load(spark, d, "orders")
    return R.keyset_page(o.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], (datetime.datetime(1997, 1, 1), 1000), 50)


@add("l05_revision_bound_page", """SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS revision, count(*) AS n FROM orders GROUP BY 1""")
def l05(spark, d):
    (o,) = load(spark, d, "orders")
    keys = F.sort_array(F.collect_list("o_orderkey")).cast("array<string>")
    return o.groupBy("o_custkey").agg(F.sha2(F.array_join(keys, ","), 256).alias("revision"), F.count("*").alias("n"))


@add("l06_capped_top", """WITH r AS (SELECT o_orderkey, o_totalprice AS heat, o_custkey % 5 AS source, o_orderkey % 3 > 0 AS single FROM orders),
c AS (SELECT *, row_number() OVER (PARTITION BY source, single ORDER BY heat DESC, o_orderkey) AS n FROM r)
SELECT o_orderkey, row_number() OVER (ORDER BY heat DESC, o_orderkey) AS place FROM c WHERE NOT single OR n <= 2 ORDER BY heat DESC, o_orderkey LIMIT 10""")
def l06(spark, d):
    (o,) = load(spark, d, "orders")
    rows = o.select("o_orderkey", F.col("o_totalprice").alias("heat"), (F.col("o_custkey") % 5).alias("source"), (F.col("o_orderkey") % 3 > 0).alias("single"))
    return R.capped_top(rows, [F.col("heat").desc(), F.col("o_orderkey")], "source", "single", 2, 10).select("o_orderkey", "place")


@add("l08_representative", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, (o_orderstatus = 'F') DESC, o_totalprice DESC NULLS LAST, o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def l08(spark, d):
    (o,) = load(spark, d, "orders")
    order = [(F.col("o_orderpriority") == "1-URGENT").desc(), (F.col("o_orderstatus") == "F").desc(), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderdate"), F.col("o_orderkey")]
    return R.distinct_on(o, ["o_custkey"], *order).select("o_custkey", "o_orderkey")


@add("l09_md5_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || 's1') LIMIT 25")
def l09(spark, d):
    (docs,) = load(spark, d, "documents")
    return R.hash_sample(docs.select("doc_id"), "doc_id", 25, "s1")


@add("l10_sort_keys", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS FIRST, c_custkey) AS place FROM customer""")
def l10(spark, d):
    (c,) = load(spark, d, "customer")
    w = Window.partitionBy("c_nationkey").orderBy(F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).desc_nulls_first(), "c_custkey")
    return c.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@add("l11_order_by_list", "SELECT n_nationkey, n_name, CAST(list_position([7, 3, 21, 0], n_nationkey) AS BIGINT) AS place FROM nation WHERE n_nationkey IN (7, 3, 21, 0)")
def l11(spark, d):
    (n,) = load(spark, d, "nation")
    return R.same_order(n.select("n_nationkey", "n_name"), "n_nationkey", [7, 3, 21, 0])


# Sets


@add("u01_union_all", "SELECT c_nationkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def u01(spark, d):
    c, s = load(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("kind")).unionByName(s.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("kind")))


@add("u02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02(spark, d):
    c, s = load(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@add("u03_selected_or_picked", "SELECT o_orderkey FROM orders WHERE o_totalprice > 350000 OR o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
def u03(spark, d):
    (o,) = load(spark, d, "orders")
    return o.where((F.col("o_totalprice") > 350000) | (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).select("o_orderkey")


@add("u04_except", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u04(spark, d):
    (o,) = load(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'P'"), "o_custkey", "left_anti")


@add("u05_except_recent", """SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' AND user_id NOT IN
(SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND event_type = 'purchase')""")
def u05(spark, d):
    (e,) = load(spark, d, "events")
    between = lambda a, b: (F.col("ts") >= ts(a)) & (F.col("ts") < ts(b))
    past = e.where(between("2024-01-08", "2024-01-15") & (F.col("event_type") == "purchase"))
    return e.where(between("2024-01-15", "2024-01-16")).select("user_id").distinct().join(past, "user_id", "left_anti")


@add("u06_overlap_with_previous", """WITH s AS (SELECT CAST(ts AS DATE) AS day, list(DISTINCT user_id ORDER BY user_id) AS keys FROM events WHERE value > 95 GROUP BY 1)
SELECT day, CAST(len(keys) AS BIGINT) AS n, list_has_any(keys, lag(keys) OVER (ORDER BY day)) AS overlaps FROM s""")
def u06(spark, d):
    (e,) = load(spark, d, "events")
    days = e.where("value > 95").groupBy(F.to_date("ts").alias("day")).agg(F.collect_set("user_id").alias("keys"))
    return days.select("day", F.size("keys").cast("long").alias("n"), F.arrays_overlap("keys", F.lag("keys").over(Window.orderBy("day"))).alias("overlaps"))


@add("u07_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u07(spark, d):
    (o,) = load(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))
