"""Bodies of made-up pages against the text that was put into them."""

import random
import re

import pytest

from tidemark.functions import pages as PG

RNG = random.Random(12)
WORDS = "the market report said that prices of goods rose again in spring, while exports fell and firms waited for new rules from the ministry".split()


def sentence(n=18):
    return " ".join(RNG.choice(WORDS) for _ in range(n)).capitalize() + "."


PARAGRAPHS = [" ".join(sentence() for _ in range(3)) for _ in range(7)]
NAV = "<nav><a href='/'>Home</a><a href='/n'>News desk</a></nav>"
LINKS = "".join(f"<li><a href='/x{k}'>Another story about number {k} with a rather long title, of course</a></li>" for k in range(20))
ASIDE = f"<div class='sidebar'><h3>Most read</h3><ul>{LINKS}</ul></div>"
COMMENTS = "<div id='comments'>" + "".join(f"<div class='comment'><p>I do not agree with this at all, reader {k} wrote, and I said so before, more than once.</p></div>" for k in range(12)) + "</div>"
FOOTER = "<footer><p>All rights reserved by the publisher of this page, whoever that may be, since 1999.</p></footer>"
ps = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
FORMS = {
    "article": f"{NAV}<article><h1>Title</h1>{ps(PARAGRAPHS)}</article>{ASIDE}{FOOTER}",
    "nested": f"<div id='page'><div class='header'>{NAV}</div><div class='main'><div class='text'>{ps(PARAGRAPHS)}</div>{COMMENTS}</div>{ASIDE}</div>{FOOTER}",
    "flat": f"{NAV}{ps(PARAGRAPHS)}<ul>{LINKS}</ul>{FOOTER}",
    "two parts": f"<div class='story'><div class='lead'>{ps(PARAGRAPHS[:4])}</div><div class='rest'>{ps(PARAGRAPHS[4:])}</div></div><div>{ASIDE}</div>",
    "breaks": f"<table><tr><td>{'<br><br>'.join(PARAGRAPHS)}</td><td><ul>{LINKS}</ul></td></tr></table>",
    "open tags": f"<div><p>{'<p>'.join(PARAGRAPHS)}</div><ul><li>{'<li>'.join(re.findall('<a.*?</a>', LINKS))}</ul>",
    "quotes": f"<main><blockquote>{PARAGRAPHS[0]}</blockquote>{ps(PARAGRAPHS[1:5])}<ul><li>{PARAGRAPHS[5]}</li><li>{PARAGRAPHS[6]}</li></ul></main><div class='related'>{ps(PARAGRAPHS[:2])}<ul>{LINKS}</ul></div>",
}


def f1(got, want):
    from collections import Counter

    a, b = Counter(re.findall(r"\w+", got.lower())), Counter(re.findall(r"\w+", want.lower()))
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values()))


@pytest.mark.parametrize("form", FORMS)
def test_the_body_is_what_was_put_in(spark, form):
    html = f"<html><head><title>T &amp; U</title><style>p {{}}</style></head><body>{FORMS[form]}<script>var p = '<p>no, not this one, ever</p>'</script></body></html>"
    (r,) = PG.extract(spark.createDataFrame([("1", "https://a.example/p", html)], "page_id string, url string, html string")).collect()
    assert r["status"] == "ok" and r["title"] == "T & U"
    assert f1(r["body"], " ".join(PARAGRAPHS)) > 0.9


def test_a_case_for_each_status(spark):
    html = f"<article>{ps(PARAGRAPHS)}</article>"
    cases = [
        ("ok", "https://a.example/p", html, 200, "https://a.example/p"), ("ok2", "https://a.example/p", html, None, None), ("short", "https://a.example/p", "<p>Short.</p>", 200, None), ("none", "https://a.example/p", None, 200, None),
        ("refused", "https://a.example/p", html, 403, None), ("limit", "https://a.example/p", html, 429, None), ("gone", "https://a.example/p", html, 404, None),
        ("login", "https://a.example/p", html, 200, "https://a.example/account/login.html?next=p"), ("asked", "https://a.example/register", html, 200, "https://a.example/register/"),
    ]
    df = spark.createDataFrame(cases, "page_id string, url string, html string, http_status int, landed string")
    out = {r["page_id"]: (r["status"], r["body"] != "") for r in PG.extract(df).collect()}
    assert out == {"ok": ("ok", True), "ok2": ("ok", True), "short": ("unconfirmed", False), "none": ("unconfirmed", False), "refused": ("refused", False), "limit": ("refused", False), "gone": ("failed", False), "login": ("sign_in", False), "asked": ("ok", True)}


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 3000 + ps(PARAGRAPHS) + "</div>" * 3000
    df = spark.createDataFrame([("1", "u", deep), ("2", "u", "<p>" * 50 + "</b></div></html>"), ("3", "u", "<![if broken <a <b"), ("4", None, "")], "page_id string, url string, html string")
    out = {r["page_id"]: r["status"] for r in PG.extract(df).collect()}
    assert out == {"1": "ok", "2": "unconfirmed", "3": "unconfirmed", "4": "unconfirmed"}
