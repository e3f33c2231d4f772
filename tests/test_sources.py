import io
import zipfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tidemark.sources import boards, feeds, sinks

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A &amp; B</title><link rel="self" href="/s"/><link href="https://a.example/1"/>
<updated>2024-02-30T00:00:00Z</updated><published>2024-02-28T23:30:00-02:00</published><author><name>Ann</name></author><category term="x"/></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item><title>R</title><link>https://r.example/</link><dc:date>2024-01-01</dc:date></item></rdf:RDF>"""


def test_feeds_of_each_kind_and_broken_ones(spark):
    df = spark.createDataFrame([("atom", ATOM), ("rdf", RDF), ("broken", "<rss><channel>"), ("null", None)], "source string, body string")
    got = {r["source"]: r for r in feeds.parse_feeds(df).collect()}
    assert (got["atom"]["title"], got["atom"]["url"], got["atom"]["published"], got["atom"]["author"], got["atom"]["categories"]) == ("A & B", "https://a.example/1", "2024-02-29T01:30:00Z", "Ann", ["x"])
    assert (got["rdf"]["url"], got["rdf"]["published"]) == ("https://r.example/", "2024-01-01T00:00:00Z")
    assert got["broken"]["error"] and "null" not in got


def test_json_items_with_templates(spark):
    df = spark.createDataFrame([("a", '{"d": {"list": [{"id": 7, "slug": "x y/z", "n": {"t": "T"}}, {"id": 8}]}}'), ("b", "no json")], "source string, body string")
    out = feeds.json_items(df, "$.d.list", {"title": "$.n.t", "url": "https://e.org/{slug}?i={raw:id}"}).collect()
    assert [tuple(r) for r in out] == [("a", 0, "T", "https://e.org/x%20y/z?i=7"), ("a", 1, None, None)]


def test_html_links_by_selector(spark):
    html = '<div class="list big"><p><a href="/1">One <b>two</b></a><time datetime="2024-01-01">x</time><br><a>no</a></p></div><div><a href="/2">out</a></div>'
    out = feeds.html_links(spark.createDataFrame([("s", html), ("n", None)], "source string, body string"), "div.list p").collect()
    assert [tuple(r) for r in out] == [("s", 0, "/1", "One two", "2024-01-01")]


def test_markdown_links(spark):
    text = '- [One](https://a/1 "t")\nsee [mid](x)\n1. **[Two](/2)**\n![p](q)[Three](/3)'
    out = feeds.markdown_links(spark.createDataFrame([("m", text)], "source string, body string")).collect()
    assert [(r["title"], r["url"]) for r in out] == [("One", "https://a/1"), ("Two", "/2"), ("Three", "/3")]


def test_changelog_dates_are_inherited(spark):
    out = feeds.changelog(spark.createDataFrame([("c", "intro\n# 2024-03-01\n## Added\na\n# 2024-02-01 v1\nb")], "source string, body string")).orderBy("place").collect()
    assert [(r["title"], str(r["day"]), r["text"]) for r in out] == [("2024-03-01", "2024-03-01", ""), ("Added", "2024-03-01", "a"), ("2024-02-01 v1", "2024-02-01", "b")]


def test_embedded_json_ends_where_it_is_balanced(spark):
    df = spark.createDataFrame([("a", 'x window.DATA = {"k": "}\\" {", "l": [1]}; y = {}'), ("b", None)], "source string, body string")
    assert {r["source"]: r["json"] for r in feeds.embedded_json(df, "DATA").collect()} == {"a": '{"k": "}\\" {", "l": [1]}', "b": None}


def test_a_push_is_taken_whole_or_not(spark):
    ok = spark.createDataFrame([(1, "https://a/1", "t"), (2, "https://a/1", "t"), (3, "https://a/2", "t")], "place int, url string, title string")
    assert [r["status"] for r in feeds.pushed(ok).orderBy("place").collect()] == ["accepted", "repeated", "accepted"]
    bad = ok.unionByName(spark.createDataFrame([(4, "ftp://x", "t")], ok.schema))
    assert {r["status"] for r in feeds.pushed(bad).collect()} == {"invalid"}


def test_gold_lines(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert feeds.gold_lines(lines("// n", "", '{"id": "a", "gold": 1}'), "id string, gold int").collect() == [("a", 1)]
    for broken in (lines('{"id": "a"', "{}"), lines('{"id": "a", "gold": 1}', '{"id": "a", "gold": 2}')):
        with pytest.raises((PySparkException, Py4JJavaError)):
            feeds.gold_lines(broken, "id string, gold int").collect()


def test_account_shards(spark):
    accounts = spark.createDataFrame([("m", f"account_{k:02}") for k in range(60)] + [("n", "x")], "mode string, handle string")
    out = feeds.account_shards(accounts).toPandas()
    sizes = out.groupby(["mode", "shard"])["handle"].agg(["count", lambda h: sum(len(x) + 9 for x in h)])
    assert len(out) == 61 and sizes["count"].max() == 24 and sizes.iloc[:, 1].max() <= 470


def test_zipped_csv_and_scores(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.csv", '﻿name,score,err\n"m, 1",0.5,0.1\nm2,x,\n,3,\n')
        z.writestr("read.me", "no")
    df = spark.createDataFrame([("p", bytearray(buffer.getvalue()))], "path string, content binary")
    rows = boards.zipped_csv(df)
    out = boards.scored(rows, rows.record["name"], rows.member, rows.record["score"], rows.record["err"]).collect()
    assert [tuple(r) for r in out] == [("m, 1", "a.csv", 0.5, 0.4, 0.6)]


def test_means_need_every_task(spark):
    scores = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 5.0), ("b", 1, 9.0), ("b", 3, 9.0)], "model string, task int, score double")
    cats = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "task int, category string")
    assert [tuple(r) for r in boards.category_means(scores, cats).collect()] == [("a", 3.5)]


def test_feed_text_is_escaped(spark):
    items = spark.sql("SELECT 1 AS id, 'a<b' AS title, 'https://e/?a&b' AS url, TIMESTAMP '2024-01-15 10:00:00' AS at, 'x]]>y' AS summary")
    xml = sinks.rss(items, "T", "https://e").first()[0]
    got = feeds.parse_feeds(spark.createDataFrame([("s", xml)], "source string, body string")).first()
    assert (got["title"], got["url"], got["published"], got["summary"]) == ("a<b", "https://e/?a&b", "2024-01-15T10:00:00Z", "x]]>y")


def test_sitemap_files(spark):
    urls = spark.range(200).selectExpr("concat('u', id % 150) AS url", "id AS changed")
    out = sinks.sitemap(urls, 40).toPandas()
    assert len(out) == 150 and out.groupby("file_no").size().max() <= 40
