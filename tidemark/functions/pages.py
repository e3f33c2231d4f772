"""Bodies of web pages: extraction by scored elements, clean blocks, records in scripts, plain text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a readable body has at least, tags that are kept, dropped whole, or block.
LEAST = 200
#: Pages that a task reads out of a batch at once.
PAGES = 32
KEPT = {"p", "h2", "h3", "h4", "ul", "ol", "li", "blockquote", "pre", "code", "a", "img", "strong", "em", "b", "i", "table", "tr", "td", "th", "figure", "figcaption", "br"}
DROPPED = {"script", "style", "nav", "footer", "aside", "form", "noscript", "iframe", "template", "svg", "button"}
BLOCKS = {"p", "div", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "td", "th", "figcaption", "article", "section"}
CLOSED = {"br", "img", "hr", "input", "meta", "link", "source", "wbr"}


class _Blocks(HTMLParser):
    """Text blocks of a page with the length of their link text, and clean markup of kept tags."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.skip, self.link = base, [], 0
        self.blocks: list[list] = [["", 0]]
        self.out: list[str] = []
        self.title, self.in_title = "", False

    def handle_starttag(self, tag, attrs):
        if self.skip:
            self.skip += [tag] * (tag == self.skip[0])
            return
        if tag in DROPPED:
            self.skip.append(tag)
            return
        self.in_title = tag == "title"
        self.link += tag == "a"
        if tag in BLOCKS:
            self.blocks.append(["", 0])
        if tag in KEPT:
            at = dict(attrs)
            link = next((f' {n}="{urljoin(self.base, at[n])}"' for n in ("href", "src") if at.get(n) and re.match(r"https?://|/|\.|\w+[./]", at[n]) and not at[n].lower().startswith(("javascript:", "data:"))), "")
            self.out.append(f"<{tag}{link}>")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            return
        self.in_title = self.in_title and tag != "title"
        self.link -= tag == "a" and self.link > 0
        if tag in BLOCKS:
            self.blocks.append(["", 0])
        if tag in KEPT and tag not in CLOSED:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.blocks[-1][0] += data
            self.blocks[-1][1] += len(data.strip()) * (self.link > 0)
            self.out.append(data.replace("&", "&amp;").replace("<", "&lt;"))


# Answers of a site that refuses a reader, and path steps of sign-in pages.
REFUSED = {401, 403, 407, 412, 429, 451}
SIGN_IN = {"login", "signin", "sign-in", "signup", "sign-up", "register", "auth", "sso"}
#: Words in an element's class or id that say it is not the article.
BESIDE = {"comment", "comments", "sidebar", "menu", "share", "social", "related", "promo", "breadcrumb", "pagination", "newsletter", "cookie", "banner", "recommend"}
#: Elements whose own text counts for what holds them, and the least characters of one that counts.
GROUPS, DEEPEST = {"ul", "ol", "div", "section", "table", "tr", "td"}, 100
TEXTS, COUNTS_FROM = {"p", "pre", "td", "blockquote", "li", "div", "section", "article"}, 25


class Element:
    """A node of a page: its own text, its children in order with texts between, and its score."""

    __slots__ = ("tag", "parent", "parts", "score", "beside", "depth")

    def __init__(self, tag: str, parent: Element | None, beside: bool = False):
        self.tag, self.parent, self.parts, self.score, self.beside = tag, parent, [], 0.0, beside
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.parts.append(self)

    def children(self) -> list[Element]:
        return [c for c in self.parts if isinstance(c, Element)]

    def own(self) -> str:
        """The text in it that no block of its own holds."""
        return " ".join("".join(c if isinstance(c, str) else c.own() if c.tag not in BLOCKS else " " for c in self.parts).split())

    def blocks(self) -> list[str]:
        """The texts of its blocks in order."""
        out, run = [], ""
        for c in self.parts:
            if isinstance(c, Element) and (c.tag in BLOCKS or any(True for k in c.walk() if k.tag in BLOCKS)):
                out += [run, *([] if c.beside or c.of_links() else c.blocks())]
                run = ""
            else:
                run += c if isinstance(c, str) else "" if c.beside else c.own() + (" " if c.tag == "br" else "")
        return [t for t in (" ".join(t.split()) for t in [*out, run]) if t]

    def of_links(self) -> bool:
        """Whether it is a group of which links make over half."""
        every, links = self.size() if self.tag in GROUPS else (0, 0)
        return 2 * links > every

    def walk(self) -> Iterator[Element]:
        stack = list(self.children())
        while stack:
            e = stack.pop()
            yield e
            stack += e.children()

    def size(self) -> tuple[int, int]:
        """How many characters it has, and how many of them in links."""
        every = links = 0
        stack = [(self, self.tag == "a")]
        while stack:
            e, linked = stack.pop()
            for c in e.parts:
                if isinstance(c, Element):
                    stack.append((c, linked or c.tag == "a"))
                else:
                    n = len("".join(c.split()))
                    every, links = every + n, links + n * linked
        return every, links


class _Tree(HTMLParser):
    """The element tree of a page's body, without what is dropped whole."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("body", None)
        self.skip: list[str] = []
        #: Elements opened below DEEPEST, whose texts are those of the one at that depth.
        self.flat: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in DROPPED or tag == "title":
            self.skip += [tag] * (not self.skip or tag == self.skip[0])
            return
        if tag in ("html", "body"):
            return
        # A block ends a paragraph left open; an item ends the one before it.
        while self.at.tag == "p" and tag in BLOCKS or tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        if self.at.depth >= DEEPEST and tag not in CLOSED:
            self.flat[tag] += 1
            return
        named = re.split(r"[^a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower())
        e = Element(tag, self.at, bool(BESIDE & set(named)))
        if tag not in CLOSED:
            self.at = e

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = self.skip[: -1 if tag == self.skip[0] else None]
            return
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        up = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        if not self.skip:
            self.at.parts.append(data)

    def drop(self):
        """Takes the tree apart, whose elements hold each other, so that it goes at once."""
        for e in list(self.root.walk()):
            e.parent = None
        self.root = self.at = None


def article(root: Element) -> list[str]:
    """The blocks of the element that holds most of a page's prose, and of siblings that go on with it.

    A text of COUNTS_FROM characters gives points by its length and its commas, all to the element
    that holds it, half to the next one up and less beyond; links take their share of an element's
    points away. Elements named as standing beside the article count for nothing.
    """
    scored = []
    for e in root.walk():
        text = e.own() if e.tag in TEXTS else ""
        if len(text) < COUNTS_FROM or e.beside:
            continue
        points = 1 + sum(text.count(c) for c in ",，、") + min(len(text) // 100, 3)
        up, level = (e.parent if e.tag in ("p", "li", "pre", "blockquote", "td") else e), 0
        while up is not None and level < 5:
            if up.score == 0:
                scored.append(up)
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1

    def prose(e: Element) -> float:
        every, links = e.size()
        return 0.0 if not every or any_beside(e) else e.score * (1 - links / every)

    def any_beside(e: Element | None) -> bool:
        return e is not None and (e.beside or any_beside(e.parent))

    if not scored:
        return []
    best = max(scored, key=prose)
    if prose(best) == 0:
        return []
    if best.parent is None:
        return best.blocks()
    out, least = [], max(10.0, 0.2 * prose(best))
    for e in best.parent.children():
        every, links = e.size()
        text = e.own()
        goes_on = e.tag == "p" and (len(text) > 80 and links < 0.25 * every or 0 < len(text) <= 80 and not links and text[-1] in ".。！？!?")
        if e is best or not e.beside and (prose(e) >= least or goes_on):
            out += e.blocks() if e.tag not in ("p", "li") or any(c.tag in BLOCKS for c in e.children()) else [text]
    return out


def sent_to_sign_in(asked: str, landed: str) -> bool:
    """Whether an answer came from a sign-in page that was not asked for."""
    steps = lambda u: {part.split(".")[0] for part in urlsplit(u or "").path.lower().split("/")}
    return bool(SIGN_IN & steps(landed)) and not SIGN_IN & steps(asked)


def _page(url: str, html: str, answer: int | None, landed: str | None) -> tuple:
    refused = "sign_in" if landed and sent_to_sign_in(url, landed) else None if answer is None or answer == 200 else "refused" if answer in REFUSED else "failed"
    if refused:
        return None, "", "", refused
    p, tree = _Blocks(landed or url), _Tree()
    p.feed(html)
    tree.feed(html)
    body = "\n\n".join(article(tree.root))
    tree.drop()
    return " ".join(p.title.split()) or None, body, re.sub(r"<p>\s*</p>", "", "".join(p.out)), "ok" if len(body) >= LEAST else "unconfirmed"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "title", "body", "html", "status"]
    for batch in batches:
        # A few pages at a time are taken out of a batch and given on, so that the batch is all that is held.
        for start in range(0, len(batch), PAGES):
            b = batch.slice(start, PAGES).to_pydict()
            rows = [(i, *_page(u or "", h or "", s, at)) for i, u, h, s, at in zip(b["page_id"], b["url"], b["html"], b["http_status"], b["landed"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, body, html, status: the readable text of each page (page_id, url, html).

    pages may have http_status and landed, the address that answered. status, the first that holds:
    `sign_in`, `refused` (an answer in REFUSED), `failed` (another answer than 200), `ok`, or
    `unconfirmed` where the body is shorter than LEAST; the first three have no body. html is the
    page's markup in kept tags, without scripts. A page that the parser gives up on has no body.
    """
    schema = "page_id string, title string, body string, html string, status string"
    column = lambda name, kind: F.col(name).cast(kind) if name in pages.columns else F.lit(None).cast(kind)
    return pages.select(F.col("page_id").cast("string"), "url", "html", column("http_status", "int").alias("http_status"), column("landed", "string").alias("landed")).mapInArrow(_extracted, schema)


def script_records(html: Column, mark: str) -> Column:
    """The contents of script blocks of a type, in order."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<script[^>]*type="{mark}"[^>]*>(.*?)</script>'), F.lit(1))


def page_title(html: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(found, "<[^>]*>", ""), r"\s+", " ")), F.lit(""))


def filled(listed: DataFrame, details: DataFrame, key: str, names: list[str]) -> DataFrame:
    """listed with each of the names from the detail page where the listing has none."""
    more = details.select(F.col(key).alias("_key"), *[F.col(n).alias(f"_{n}") for n in names])
    return listed.join(more, F.col(key) == F.col("_key"), "left").withColumns({n: F.coalesce(F.nullif(F.trim(n), F.lit("")), F.col(f"_{n}")) for n in names}).drop("_key", *[f"_{n}" for n in names])


def text_to_html(text: Column) -> Column:
    """Paragraphs at empty lines, line breaks within them; markup characters are escaped."""
    safe = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    # A lambda of one parameter: trim takes a second one, the signs to trim, and would be given the index.
    parts = F.filter(F.transform(F.split(safe, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")  # noqa: PLW0108
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def shielded(html: Column) -> Column:
    """text and parts: tags, code and links set apart behind numbered marks before a translation."""
    parts = F.regexp_extract_all(html, F.lit(r"(?s)<(?:code|pre)>.*?</(?:code|pre)>|<[^>]+>"), F.lit(0))
    pieces = F.split(html, r"(?s)<(?:code|pre)>.*?</(?:code|pre)>|<[^>]+>", -1)
    text = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("⟦"), (i - 1).cast("string"), F.lit("⟧"), p))), "")
    return F.struct(text.alias("text"), parts.alias("parts"))


def unshielded(text: Column, parts: Column) -> Column:
    """The translation with its parts back; null unless each mark is there exactly once."""
    marks = F.regexp_extract_all(text, F.lit("⟦([0-9]+)⟧"), F.lit(1)).cast("array<int>")
    whole = F.when(F.size(parts) == 0, F.size(marks) == 0).otherwise(F.sort_array(marks) == F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))))
    pieces = F.split(text, "⟦[0-9]+⟧", -1)
    back = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(parts, F.get(marks, i - 1)), p))), "")
    return F.when(whole, back)


def labelled(output: Column, names: list[str]) -> Column:
    """A struct of the parts `name: text` of a labelled answer; a missing or empty part is null."""
    stop = "|".join(names)
    part = lambda n: F.nullif(F.trim(F.regexp_extract(output, rf"(?s)(?:^|\n)\s*{n}\s*[::]\s*(.*?)(?=\n\s*(?:{stop})\s*[::]|$)", 1)), F.lit(""))
    return F.struct(*[part(n).alias(n) for n in names])


def quoted_in(quote: Column, post: Column) -> Column:
    """Whether all parts of a quote, between the dots that leave something out, are in the post."""
    loose = lambda s: F.lower(F.regexp_replace(s, r"[\s\p{P}\p{S}]+", ""))
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), loose), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(loose(post), p))
