"""Feeds, JSON lists, pages and markdown to candidate rows.

Bodies are a column of any frame: `spark.read.format("binaryFile")`, a table, or a stream. What
SQL functions can say stays there; XML and HTML are read in tasks, a few rows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.session import checkpointed

FEED = "source string, place int, title string, url string, published string, summary string, author string, categories array<string>, error string"
LINKS = "source string, place int, url string, title string, date string"
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _stamp(text: str | None) -> str | None:
    """An RFC 822 or ISO date as ISO text in UTC; null if it is no date of the calendar."""
    if not text or not text.strip():
        return None
    try:
        at = pd.Timestamp(text.strip()) if re.match(r"\d{4}-", text.strip()) else pd.Timestamp(parsedate_to_datetime(text.strip()))
        return (at.tz_localize("UTC") if at.tzinfo is None else at.tz_convert("UTC")).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (ValueError, TypeError):
        return None


def feed_entries(xml: str) -> Iterator[tuple]:
    """title, url, published, summary, author, categories of each entry of an RSS, RDF or Atom text."""
    for node in ElementTree.fromstring(xml).iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        links, cats = [], []
        for x in node:
            name, text = _local(x.tag), "".join(x.itertext()).strip()
            if name == "link":
                links.append((x.get("rel", "alternate") != "alternate", x.get("href") or text))
            elif name == "category":
                cats.append(x.get("term") or text)
            elif text:
                got.setdefault(name, text)
        url = min(links, default=(0, got.get("guid") or got.get("id")), key=lambda p: p[0])[1]
        at = next((s for n in ("pubdate", "published", "date", "updated") if (s := _stamp(got.get(n)))), None)
        yield got.get("title"), url or None, at, got.get("encoded") or got.get("description") or got.get("summary") or got.get("content"), got.get("creator") or got.get("author"), cats


def on_through_pages(rows: DataFrame, counted: Column) -> DataFrame:
    """rows (source, page, place) with places that go on from page to page of a source: each page
    starts behind the rows of those before that are counted. Only one row a page is brought together."""
    sizes = rows.groupBy("source", "page").agg(F.count_if(counted).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("source").alias("_s"), F.col("page").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("page") == F.col("_p"))).withColumn("place", F.col("place") + F.col("_start")).drop("_s", "_p", "_start")


def parse_feeds(bodies: DataFrame) -> DataFrame:
    """source, place, title, url, published, summary, author, categories, error: the entries of each
    body in order. bodies: source, body. A body that is no XML gives one row with its error only;
    a null one none. A feed may come in pages, numbered in `page`; then places go on through them
    and are longs."""
    paged = "page" in bodies.columns
    schema = f"page long, {FEED}" if paged else FEED
    names = [f.split()[0] for f in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            pages = [(p,) for p in b["page"]] if paged else [()] * len(b)
            for page, source, body in zip(pages, b["source"], b["body"], strict=True):
                try:
                    out += [(*page, source, k, *e, None) for k, e in enumerate(feed_entries(body))] if body else []
                except ElementTree.ParseError as e:
                    out.append((*page, source, 0, None, None, None, None, None, [], str(e)))
            yield pd.DataFrame(out, columns=names)

    rows = bodies.select(*[F.col("page").cast("long")] * paged, F.col("source").cast("string"), F.col("body").cast("string")).mapInPandas(run, schema)
    # Read twice below, parsed once.
    return on_through_pages(checkpointed(rows), F.col("error").isNull()).drop("page") if paged else rows


def changed(listings: DataFrame, state: DataFrame) -> DataFrame:
    """listings (source, etag, body) whose etag, or without one whose body's hash, is not the stored
    one. state: source, mark."""
    marked = listings.withColumn("mark", F.coalesce("etag", F.sha2(F.coalesce("body", F.lit("")), 256)))
    return marked.join(state.select("source", "mark"), ["source", "mark"], "left_anti")


def json_items(bodies: DataFrame, items: str, fields: dict[str, str]) -> DataFrame:
    """source, place and a column a field, for each element of the list at the path `items`.

    fields: names to paths from the element, or templates as in template(). Texts stay texts.
    """
    rows = bodies.select("source", F.posexplode(F.from_json(F.get_json_object("body", items), "array<string>")).alias("place", "_item"))
    return rows.select("source", "place", *[template(F.col("_item"), path).alias(name) for name, path in fields.items()])


def template(item: Column, pattern: str) -> Column:
    """A path `$.a.b`, or a text with {a.b} (percent-encoded, slashes kept) and {raw:a.b}; null
    where any path is missing."""
    if pattern.startswith("$"):
        return F.get_json_object(item, pattern)
    parts = []
    for k, part in enumerate(re.split(r"\{([^}]*)\}", pattern)):
        if k % 2 == 0:
            parts.append(F.lit(part))
        elif part.startswith("raw:"):
            parts.append(F.get_json_object(item, f"$.{part[4:]}"))
        else:
            value = F.url_encode(F.get_json_object(item, f"$.{part}"))
            parts.append(F.replace(F.replace(value, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))
    return F.concat(*parts)


def markdown_links(bodies: DataFrame) -> DataFrame:
    """source, place, title, url: links that begin a line or list item, pictures left out."""
    clean = F.regexp_replace("body", r"!\[[^\]]*\]\([^)]*\)", "")
    line = r"(?m)^[ \t]*(?:[-*+] |\d+\. )?\**\[([^\]\n]+)\]\(([^)\s]+)(?: \"[^\"\n]*\")?\)"
    found = F.arrays_zip(F.regexp_extract_all(clean, F.lit(line), F.lit(1)).alias("title"), F.regexp_extract_all(clean, F.lit(line), F.lit(2)).alias("url"))
    return bodies.select("source", F.posexplode(found).alias("place", "_l")).select("source", "place", "_l.title", "_l.url")


def changelog(bodies: DataFrame) -> DataFrame:
    """source, place, title, day, text: the sections of a page of changes; a section without a date
    in its heading takes the one of the section above. Changes may come in several pages, numbered
    in `page` and cut between sections; then places, and dates above, go on through them."""
    paged = "page" in bodies.columns
    parts = F.filter(F.split("body", r"(?m)^(?=#{1,4} )"), lambda p: p.startswith("#"))
    own_page = ["source", "page"] if paged else ["source"]
    rows = bodies.select(*own_page, F.posexplode(parts).alias("place", "_part"))
    head = F.trim(F.regexp_extract("_part", r"^#{1,4} +([^\n]*)", 1))
    own = F.try_to_date(F.regexp_extract(head, r"(\d{4}-\d{2}-\d{2})", 1))
    above = F.last("_day", ignorenulls=True).over(Window.partitionBy(*own_page).orderBy("place"))
    text = F.regexp_replace("_part", r"^[^\n]*\n?|\s+$", "")
    dated = rows.select(*own_page, "place", head.alias("title"), own.alias("_day"), text.alias("text")).withColumn("day", above).drop("_day")
    if not paged:
        return dated
    dated = checkpointed(dated)
    # The last date of the pages before is above the first sections of a page.
    last = dated.groupBy("source", "page").agg(F.max(F.when(F.col("day").isNotNull(), F.struct("place", "day")))["day"].alias("_last"))
    until = F.last("_last", ignorenulls=True).over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(F.col("source").alias("_s"), F.col("page").alias("_p"), until.alias("_until"))
    both = dated.join(carried, F.col("source").eqNullSafe(F.col("_s")) & (F.col("page") == F.col("_p"))).withColumn("day", F.coalesce("day", "_until")).drop("_s", "_p", "_until")
    return on_through_pages(both, F.lit(True)).select("source", "place", "title", "text", "day")


class _Links(HTMLParser):
    """Links inside elements that a selector names: tag, .class or #id, descendants by spaces."""

    def __init__(self, selector: str):
        super().__init__()
        self.steps = selector.split()
        self.open: list[tuple[str, dict]] = []
        self.found: list[list] = []
        self.inside: list | None = None
        self.day = None

    @staticmethod
    def fits(step: str, tag: str, at: dict) -> bool:
        name, _, cls = step.partition(".")
        name, _, ident = name.partition("#")
        return (not name or name == tag) and (not cls or cls in (at.get("class") or "").split()) and (not ident or at.get("id") == ident)

    def within(self) -> bool:
        k = 0
        for tag, at in self.open:
            k += k < len(self.steps) and self.fits(self.steps[k], tag, at)
        return k == len(self.steps)

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag not in VOID:
            self.open.append((tag, at))
        if tag == "a" and at.get("href") and self.within():
            self.inside = [at["href"], "", None]
            self.found.append(self.inside)
        if tag == "time" and self.found and self.within():
            self.found[-1][2] = at.get("datetime")

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = None
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if self.inside is not None:
            self.inside[1] += data


def html_links(pages: DataFrame, selector: str) -> DataFrame:
    """source, place, url, title, date of the links in what the selector names. pages: source, body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, body in zip(b["source"], b["body"], strict=True):
                p = _Links(selector)
                p.feed(body or "")
                out += [(source, k, url, " ".join(title.split()), day) for k, (url, title, day) in enumerate(p.found)]
            yield pd.DataFrame(out, columns=["source", "place", "url", "title", "date"])

    return pages.select(F.col("source").cast("string"), F.col("body").cast("string")).mapInPandas(run, LINKS)


def embedded_json(pages: DataFrame, name: str) -> DataFrame:
    """source, json: the value assigned to a script variable, read to its balanced end; null if none."""
    start = re.compile(rf"(?:window\.|var |let |const ){re.escape(name)}\s*=\s*(?=[\[{{])")

    def value(body: str | None) -> str | None:
        m = start.search(body or "")
        if m is None:
            return None
        depth, quoted, skip = 0, False, False
        for i in range(m.end(), len(body)):
            c = body[i]
            if quoted:
                quoted, skip = skip or c != '"', not skip and c == "\\"
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                if not depth:
                    return body[m.end() : i + 1]
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"source": b["source"], "json": [value(x) for x in b["body"]]})

    return pages.select(F.col("source").cast("string"), F.col("body").cast("string")).mapInPandas(run, "source string, json string")


def pushed(batches: DataFrame, most: int = 50) -> DataFrame:
    """batches (batch, place, url, title) with status: `invalid` for all of a batch if any of its
    rows is, or it has more than `most` rows; else `accepted` once an address, then `repeated`.
    A batch is at most what one caller sends; without that column all rows are one."""
    if "batch" not in batches.columns:
        return pushed(batches.withColumn("batch", F.lit(0)), most).drop("batch")
    bad = F.coalesce(~F.col("url").rlike("^https?://[^/ ]+"), F.lit(True)) | F.coalesce(F.trim("title") == "", F.lit(True))
    whole = batches.groupBy("batch").agg(F.bool_or(bad).alias("_bad"), F.count("*").alias("_n"))
    nth = F.row_number().over(Window.partitionBy("batch", "url").orderBy("place"))
    status = F.when(F.col("_bad") | (F.col("_n") > most), "invalid").when(nth == 1, "accepted").otherwise("repeated")
    return batches.join(whole, "batch").withColumn("status", status).drop("_bad", "_n")


def gold_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The records of JSON lines (column value); lines that are empty or begin with // are notes.

    A broken line or an id that comes twice is an error, raised when the rows are read.
    """
    kept = lines.where(~F.col("value").rlike(r"^\s*(//|$)"))
    rows = kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    times = F.count("*").over(Window.partitionBy("id"))
    return rows.withColumn("_n", times).withColumn("id", F.when(F.col("_n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("id comes twice: "), F.col("id").cast("string"))))).drop("_n")


def account_shards(accounts: DataFrame, longest: int = 470, most: int = 24, joiner: int = 9) -> DataFrame:
    """mode, handle, shard: accounts (mode, handle) packed, in order, into queries of bounded length.

    Each account adds its handle and a joiner; one longer than a query has one by itself. Modes are
    packed apart, by next fit: where a shard would end is known of every account from the `most`
    accounts behind it, which lie in its block of places or the next one's head; the shards that
    there are begin where jumping from a mode's first account leads. So no task holds a mode.
    """
    rows = R.positions(accounts.select("mode", "handle"), "mode", ["handle"]).withColumn("cost", F.length("handle") + joiner)
    block = 1024
    place = F.col("seq") - F.col("first")
    own = rows.select("mode", "seq", "cost", F.floor(place / block).alias("block"), F.lit(True).alias("own"))
    # The head of a block is shown to the one before it.
    head = rows.where((place >= block) & (place % block < most)).select("mode", "seq", "cost", (F.floor(place / block) - 1).alias("block"), F.lit(False).alias("own"))
    ahead = Window.partitionBy("mode", "block").orderBy("seq").rowsBetween(Window.currentRow, most)
    costs = F.collect_list("cost").over(ahead)
    # The first one that makes it too long, counted from the first one on, which always fits.
    sums = F.transform(F.sequence(F.lit(1), F.size("_c")), lambda k: F.aggregate(F.slice("_c", F.lit(1), k), F.lit(0), lambda n, c: n + c))
    over = F.array_position(F.transform(sums, lambda n, i: (i > 0) & (n > longest)), F.lit(True)) - 1
    size = F.least(F.when(over > 0, over).otherwise(F.size("_c")), F.lit(most))
    ends = own.unionByName(head).withColumn("_c", costs).where("own").select("mode", F.col("seq").alias("at"), (F.col("seq") + size).alias("to"))
    last = rows.groupBy("mode").agg(F.max("seq").alias("last"))
    jumps = checkpointed(ends.join(last, "mode").select("mode", "at", "to", F.when(F.col("to") <= F.col("last"), F.col("to")).alias("next")))
    starts = R.orbit(jumps.select("at", F.col("next").alias("to")), rows.select(F.col("first").alias("at")).distinct())
    shards = starts.join(jumps, "at").select(F.explode(F.sequence("at", F.col("to") - 1)).alias("seq"), F.col("nth").cast("int").alias("shard"))
    return rows.join(shards, "seq").select("mode", "handle", "shard")


def unread(posts: DataFrame, marks: DataFrame) -> DataFrame:
    """posts not read yet, once each: newer than their account's mark, or in a stretch left behind.

    posts: account, post_id (digits as text, compared as numbers), repost. marks: account, mark,
    backlog (array of from, to: what lies between pages that were cut off). Reposts are left out.
    """
    number = F.col("post_id").cast("decimal(20,0)")
    known = marks.select(F.col("account").alias("_a"), F.col("mark").cast("decimal(20,0)").alias("_mark"), F.col("backlog").alias("_backlog"))
    rows = posts.where(~F.coalesce("repost", F.lit(False))).dropDuplicates(["account", "post_id"]).withColumn("_n", number)
    behind = F.exists(F.coalesce("_backlog", F.array().cast("array<struct<from:decimal(20,0),to:decimal(20,0)>>")), lambda s: (F.col("_n") > s["from"]) & (F.col("_n") <= s["to"]))
    return rows.join(known, F.col("account") == F.col("_a"), "left").where(F.col("_mark").isNull() | (F.col("_n") > F.col("_mark")) | behind).drop("_a", "_mark", "_backlog", "_n")


def new_marks(posts: DataFrame) -> DataFrame:
    """account, mark: the highest post of each account, for the next run."""
    return posts.groupBy("account").agg(F.max(F.col("post_id").cast("decimal(20,0)")).cast("string").alias("mark"))


def post_candidates(posts: DataFrame) -> DataFrame:
    """url, title, published, author, excerpt of posts (handle, post_id, text, at, quoted): the title is
    the first line, a quoted text follows the own one."""
    first = F.trim(F.split("text", "\n")[0])
    url = F.concat(F.lit("https://x.com/"), F.col("handle"), F.lit("/status/"), F.col("post_id"))
    return posts.select(url.alias("url"), F.substring(first, 1, 200).alias("title"), F.col("at").alias("published"), F.col("handle").alias("author"), F.concat_ws("\n> ", "text", "quoted").alias("excerpt"))


def own_posts(posts: DataFrame, account: str, since: Column) -> DataFrame:
    """The account's own posts since a time, latest first."""
    return posts.where((F.col("account") == account) & (F.col("at") >= since)).orderBy(F.col("at").desc(), F.col("post_id").desc())


def listing_filter(rows: DataFrame, include: tuple[str, str] | None = None, exclude: tuple[str, str] | None = None, require: str | None = None, least: tuple[str, float] | None = None) -> DataFrame:
    """rows whose columns fit: (column, pattern) that must or must not match, a column that must be
    true, (column, number) that it must reach. A null fits no test but exclude."""
    if include:
        rows = rows.where(F.col(include[0]).rlike(include[1]))
    if exclude:
        rows = rows.where(~F.coalesce(F.col(exclude[0]).rlike(exclude[1]), F.lit(False)))
    if require:
        rows = rows.where(F.col(require))
    return rows.where(F.col(least[0]) >= least[1]) if least else rows
