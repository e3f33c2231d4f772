"""Versions of materials, listing by listing, against a plain second version; boards read page by page."""

import datetime
import json
import random

import pytest

from tidemark.functions import text as T
from tidemark.functions import url as U
from tidemark.operators import publish as P
from tidemark.operators import reading as V
from tidemark.sources import boards as B

SCHEMA = "identity string, source string, discovered timestamp_ntz, title string, body string, excerpt string, imported boolean"


def hour(k):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)


def outcomes(spark, rows):
    out = P.versions(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r["identity"], r["discovered"]): (r["outcome"], r["revision"]) for r in out}


def test_cases(spark):
    say = lambda k, body, source="s", imported=False, i="m": (i, source, hour(k), "T", body, None, imported)
    texts = ["first text", "first text", "second text", "first text", "second tex�", None, "third", "x", "second  text"]
    sources = ["s", "s", "s", "s", "s", "s", "s", "other", "s"]
    out = outcomes(spark, [say(k, t, s) for k, (t, s) in enumerate(zip(texts, sources))] + [say(0, "old", imported=True, i="n"), say(1, "new", i="n"), say(2, "newer", i="n"), say(3, "new", i="n")])
    assert [out["m", hour(k)] for k in range(9)] == [("created", 1), ("unchanged", 1), ("revised", 2), ("seen", 2), ("lossy", 2), ("unchanged", 2), ("revised", 3), ("discovery", 3), ("seen", 3)]
    assert [out["n", hour(k)] for k in range(4)] == [("created", 1), ("baseline", 1), ("revised", 2), ("seen", 2)]


def test_as_by_a_second_version(spark):
    """Hashes and equality by the column expressions, the order of decisions once more."""
    rng = random.Random(6)
    made = ["alpha beta", "alpha  beta ", "alpha bet�", "gamma", "gam�a", "delta\nx", None, ""]
    rows = [(f"i{k % 9}", rng.choice("aab"), hour(k), rng.choice(["T", "U", " T"]), rng.choice(made), rng.choice(made[:2] + [None]), rng.random() < 0.2) for k in range(300)]
    every = {(t, b, e) for t in ("T", "U", " T") for b in made for e in made[:2] + [None]}
    df = spark.createDataFrame(sorted(every, key=str), "t string, b string, e string")
    c = T.F.col
    hashes = {(r["t"], r["b"], r["e"]): r["h"] for r in df.select("*", U.content_hash(c("t"), c("b"), c("e")).alias("h")).collect()}
    pairs = spark.createDataFrame([(x, y) for x in [*made, "T", "U", " T"] for y in [*made, "T", "U", " T"]], "x string, y string")
    same = {(r["x"], r["y"]): r["s"] for r in pairs.select("x", "y", T.equal_but_for_loss(c("x"), c("y")).alias("s")).collect()}
    want, held = {}, {}
    for i, source, at, title, body, excerpt, imported in sorted(rows, key=lambda r: r[2]):
        now = held.get(i)
        if now is None:
            now = held[i] = {"source": source, "t": (title, body, excerpt), "rev": 1, "hash": None if imported else hashes[title, body, excerpt], "had": set()}
            outcome = "created"
        elif now["source"] != source:
            outcome = "discovery"
        else:
            t = (title, body if body is not None else now["t"][1], excerpt if excerpt is not None else now["t"][2])
            new = hashes[t]
            if new == now["hash"]:
                outcome = "unchanged"
            elif now["hash"] is None:
                outcome, now["hash"] = "baseline", new
                now["t"] = (now["t"][0], now["t"][1], now["t"][2] if now["t"][2] is not None else excerpt)
            elif new in now["had"]:
                outcome = "seen"
            elif all(same[a, b] for a, b in zip(now["t"], t)):
                outcome = "lossy"
            else:
                outcome = "revised"
                now.update(t=t, rev=now["rev"] + 1, hash=new)
        now["had"].add(now["hash"])
        want[i, at] = (outcome, now["rev"])
    assert outcomes(spark, rows) == want
    assert {o for o, _ in want.values()} == {"created", "discovery", "unchanged", "baseline", "seen", "lossy", "revised"}


def test_pages_are_asked_for_until_there_are_no_more(spark, tmp_path):
    page = lambda rows, more: json.dumps({"data": [{"slug": s, "name": s, "score": v} for s, v in rows], "has_more": more})
    for name, pages in {"a": [page([("X.1", 2.0), ("y", None)], True), page([("z", 1.0)], False), page([("never", 9.0)], False)], "b": [page([("b", 3.0)], False)]}.items():
        for k, body in enumerate(pages, 1):
            (tmp_path / f"{name}-{k}.json").write_text(body)
    spark.dataSource.register(B.PagedSource)
    sources = {n: f"file://{tmp_path}/{n}-{{page}}.json" for n in "ab"}
    got = spark.read.format("paged_json").option("sources", json.dumps(sources)).load()
    assert sorted((r["source"], r["page"]) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    rows = sorted(map(tuple, B.board_rows("paged_json", {}, got).collect()))
    assert rows == [("a", "x-1", 2.0), ("a", "z", 1.0), ("b", "b", 3.0)]
    assert spark.read.format("paged_json").option("sources", json.dumps(sources)).option("most", 1).load().count() == 2


def test_a_missing_page_ends_the_list(spark):
    body = '{"data": [{"slug": "m", "name": "m", "score": 1.0}], "has_more": true}'
    out = B.paged_json(spark.createDataFrame([("s", 1, body), ("s", 3, body), ("t", 2, body), ("u", 1, "broken"), ("u", 2, body)], "source string, page int, body string"))
    assert [r["source"] for r in out.collect()] == ["s"]


def test_kinds_and_keys_are_checked(spark):
    bodies = spark.createDataFrame([], "path string, body string")
    with pytest.raises(ValueError, match="no board is of kind xml"):
        B.board_rows("xml", {}, bodies)
    with pytest.raises(ValueError, match="csv has no key most"):
        B.board_rows("csv", {"most": 1, "model": "m", "score": "s"}, bodies)
    assert V.checked_source("rss", {"url": "u"}) == {"url": "u"}
    for kind, config in (("ftp", {}), ("push", {"url": "u", "token_name": "t"})):
        with pytest.raises(ValueError) as raised:
            V.checked_source(kind, config)
        issue = spark.range(1).select(V.source_issue(V.F.lit(kind), V.F.array(*map(V.F.lit, config)).cast("array<string>"))).first()[0]
        assert issue == str(raised.value)
