import re
from collections import defaultdict

import pytest

from tidemark.llm import quality

SCHEMA = "doc_id long, source string, text string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    t = text or ""
    w = WORD.findall(t)
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    marked = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def brute(rows):
    norm = lambda x: re.sub(r"\s+", " ", x).strip(" ").lower()
    docs = defaultdict(set)
    hosts = defaultdict(set)
    judged = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    for i, s, t, _ in rows:
        hosts[s].add(i)
        for x in judged(t):
            docs[(s, norm(x))].add(i)
    def common(host, line, n):
        if len(WORD.findall(line)) >= 5:
            return n >= 5 and (n > 20 or n > 0.1 * len(hosts[host]))
        return n >= 10 and n > 0.3 * len(hosts[host])

    over = {k: min(v) for k, v in docs.items() if common(*k, len(v))}
    out = []
    for i, s, t, _ in rows:
        base = brute_base(t)
        n, rep = base[0], base[4]
        failed = n < 10 or 100 * rep > 20 * n
        gone = [x for x in judged(t) if over.get((s, norm(x)), i) != i]
        lost = sum(len(WORD.findall(x)) for x in gone)
        left = "\n".join(x for x in (t or "").split("\n") if x not in gone)
        out.append((i, s, *base, failed, lost, not failed and n - lost >= 0.5 * n, left if t is not None else None))
    return out


ODD = [None, "", "   \n\t ", "a b c d e a b c d e a b c d e", "x " * 300, "one\n\n\none\n two \none", "## ** $$ %% && || << >>", "é ü　ß x \x0b y \x0c z", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", " ".join(f"u{k}" for k in range(40)) + " a b c d e f a b c d e f"]


def corpus():
    rows = []
    own = lambda k: f"the {k} text has words of its own like w{k} x{k * 3} y{k * 7} and z{k} for sure"
    for k in range(120):
        text = own(k)
        if k % 2:
            text = "Please  accept all of our cookies\n" + text
        if k % 4:
            text = f"main  menu\n{text}\n" + ("more of it" if k % 8 == 1 else "next")
        if k % 10 == 3:
            text = "subscribe to our daily news letter\nshare this page with all your friends\nread the terms of this site today\n" + f"short own {k}"
        rows.append((k, f"h{k % 2}" if k % 3 else "hot", text, len(text)))
    rows += [(200 + k, None if k % 2 else "odd", t, 0) for k, t in enumerate(ODD)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as w", "2 as h", "3 as kept")
    verdict, _ = quality.judge(docs)
    want = sorted((r[:-1] for r in brute(rows)), key=str)
    assert sorted(map(tuple, verdict.collect()), key=str) == want
    assert any(r[8] for r in want) and any(not r[7] and not r[9] for r in want)
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(docs).collect()}
    assert cleaned == {r[0]: r[-1] for r in brute(rows) if r[9]}
    assert quality.clean(docs).columns == docs.columns


def test_repeated_rows_and_null_ids(spark):
    text = "boiler plate line of five words\n" + " ".join(f"own{k}" for k in range(20))
    rows = [(1, "h", text, 5), (1, "h", text, 5), (None, "h", text, 5), (None, None, text, 5)]
    out = quality.judge(spark.createDataFrame(rows, SCHEMA))[0].collect()
    assert len(out) == 4 and all(r["kept"] for r in out)
    assert quality.clean(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty)[0].count() == 0 and quality.clean(empty).count() == 0
    long = "\n".join(" ".join(f"w{(i * 31 + j) % 997}x{i}" for j in range(12)) for i in range(3000))
    repeats = "same words again and once more " * 4000
    out = {r["doc_id"]: tuple(r)[2:7] for r in quality.judge(spark.createDataFrame([(1, "h", long, 0), (2, "h", repeats, 0)], SCHEMA))[0].collect()}
    assert out == {1: brute_base(long), 2: brute_base(repeats)}


@pytest.mark.parametrize("hot", [400])
def test_common_line_keeps_one(spark, hot):
    rows = [(k, "hot", "every page of this host says so\n" + f"and then page {k} has a text of its own with more than half of the words here", 0) for k in range(hot)]
    kept = quality.clean(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(kept) == hot
    assert [r["doc_id"] for r in kept if r["text"].startswith("every")] == [0]
