"""What readers outside get: feeds, sitemaps, markdown and gold lines, as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import escape_xml

#: Addresses that one sitemap file may hold.
SITEMAP = 45_000


def rfc822(at: Column) -> Column:
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def rss(items: DataFrame, title: str, link: str, n: int = 50) -> DataFrame:
    """xml: one row, the latest n items (title, url, at, summary, id) as an RSS 2.0 feed.

    Only n rows reach the one task that puts the feed together.
    """
    top = items.orderBy(F.col("at").desc(), F.col("id").desc()).limit(n)
    e = lambda c: escape_xml(F.coalesce(F.col(c), F.lit("")))
    guard = F.replace(F.coalesce("summary", F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    entry = F.concat(F.lit("<item><title>"), e("title"), F.lit("</title><link>"), e("url"), F.lit('</link><guid isPermaLink="false">'), F.col("id").cast("string"), F.lit("</guid><pubDate>"), rfc822(F.col("at")), F.lit("</pubDate><description><![CDATA["), guard, F.lit("]]></description></item>"))
    rows = top.select(F.struct(F.col("at"), F.col("id"), entry.alias("x")).alias("s"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("s"), asc=False), lambda s: s["x"]), "")
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link>'
    return rows.agg(F.concat(F.lit(head), body, F.lit("</channel></rss>")).alias("xml"))


def sitemap(entries: DataFrame, most: int = SITEMAP) -> DataFrame:
    """file_no, url, changed: entries (url, changed) dealt into files of at most `most` addresses.

    An address is listed once, with its latest change. Files follow from a hash of the address, so
    no task sees all of them; a file holds half of `most` on average, which no file passes by chance.
    """
    one = entries.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("changed").alias("changed"))
    files = one.agg(F.ceil(F.count("*") / F.lit(most / 2)).alias("_files"))
    return one.crossJoin(F.broadcast(files)).select(F.pmod(F.xxhash64("url"), F.greatest(F.col("_files"), F.lit(1))).cast("int").alias("file_no"), "url", "changed")


def markdown(items: DataFrame) -> DataFrame:
    """id, markdown of each item (id, title, url, source, at, summary, body); missing parts are left out."""
    line = lambda mark, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(mark), F.trim(c)))
    head = F.concat_ws("\n", line("- Source: ", F.col("source")), line("- Link: ", F.col("url")), line("- Date: ", F.date_format("at", "yyyy-MM-dd")))
    return items.select("id", F.concat_ws("\n\n", line("# ", F.col("title")), F.nullif(head, F.lit("")), line("> ", F.regexp_replace("summary", "\n", "\n> ")), line("", F.col("body"))).alias("markdown"))


def page_list(entries: DataFrame, available: DataFrame, name: str, about: str) -> DataFrame:
    """value: a site's list of pages for agents, one text.

    entries: section, section_nth, nth, title, url, note, needs. An entry is there if what it needs
    is among available (kind), or if it needs nothing; a section without entries is left out. A
    site's pages are few.
    """
    there = entries.join(available.select(F.col("kind").alias("needs"), F.lit(True).alias("_has")).distinct(), "needs", "left").where(F.col("needs").isNull() | F.col("_has"))
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.nullif(F.trim("note"), F.lit(""))), F.lit("")))
    sections = there.groupBy("section", "section_nth").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    parts = sections.agg(F.array_sort(F.collect_list(F.struct("section_nth", text.alias("text")))).alias("parts"))
    head = F.lit(f"# {name}\n\n> {about}\n\n")
    return parts.select(F.concat(head, F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("value"))


def gold_jsonl(rows: DataFrame, id_column: str) -> DataFrame:
    """value: a JSON text a row, in the order of ids, to be written as text files."""
    return rows.sort(id_column).select(F.to_json(F.struct("*")).alias("value"))


def latest_by_source(entries: DataFrame, n: int = 10) -> DataFrame:
    """source, urls: the latest n addresses of each source (source, url, at), newest first."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.col("at").desc(), "url"))
    top = entries.withColumn("_n", nth).where(F.col("_n") <= n)
    return top.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "url"))), lambda s: s["url"]).alias("urls"))


def agent_lines(rows: DataFrame, order: list, most: int) -> DataFrame:
    """id, nth, lines: the first rows as a numbered Markdown list for an assistant that reads it:
    linked title, then source, Beijing time and category. rows: id, title, source, at, category."""
    top = rows.orderBy(*order).limit(most).withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    title = F.regexp_replace("title", r"([\[\]])", r"\\$1")
    stamp = F.date_format(F.col("at") + F.expr("INTERVAL 8 HOURS"), "MM-dd HH:mm")
    head = F.concat(F.col("nth").cast("string"), F.lit(". ["), title, F.lit("](/items/"), F.col("id").cast("string"), F.lit(")"))
    return top.select("id", "nth", F.concat(head, F.lit("\n   "), F.concat_ws(" · ", "source", stamp, "category")).alias("lines"))
