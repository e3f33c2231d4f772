"""The divergence audit against plain counting."""

import re
from collections import Counter, defaultdict
from itertools import groupby

import pytest

from tidemark.llm import divergence as D


def audited(rows, least, top):
    """The same by dictionaries."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    seen, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, words in docs:
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = sorted({s for x, s, _ in docs if x == lang}, key=str.encode)
        tables = {s: counts[lang, s] for s in sources}
        tables[None] = sum(tables.values(), Counter())
        total = {s: sum(t[k] for k in kept) for s, t in tables.items()}
        p = {(s, k): 1 + 10**9 * (t[k] + 5) // (total[s] + 5 * len(kept)) for s, t in tables.items() for k in kept}
        for s in sources:
            out += [(lang, s, "pair", o, sum(abs(p[s, k] - p[o, k]) for k in kept)) for o in sources if o != s]
            out += [(lang, s, "term", k, p[s, k] - p[None, k]) for k in kept if tables[s][k] and p[s, k] > p[None, k]]
    out.sort(key=lambda r: (r[:3], -r[4], r[3].encode()))
    ranked = [(*r, n) for _, g in groupby(out, key=lambda r: r[:3]) for n, r in enumerate(g, 1)]
    return sorted(r for r in ranked if r[2] == "pair" or r[5] <= top)


ROWS = [(f"Alpha beta {'gamma ' * (k % 4)} É{k % 3} Ünder_score x{'delta' if k % 5 else 'Delta-epsilon'} 日本 {chr(0x1F600 + k % 2)}", "en" if k % 3 else "de", f"s{k % 7}") for k in range(120)]
ODD = [(None, None, None), ("", "en", "empty"), (None, "", None), ("alone in its language", "xx", "one"), ("two sources", "yy", "a"), (" \n", "yy", "b"), ("A a A ÀÀ àà", "zz", None), ("a", "zz", "ö"), ("a", "zz", "z"), ("word " * 20_000, "en", "s1"), ("same", "en", "s1"), ("same", "en", "s1")]


@pytest.mark.parametrize(("least", "block"), [(1, 256), (2, 3), (30, 2), (1000, 2)])
def test_as_by_plain_counting(spark, least, block):
    rows = ROWS + ODD + [("hot one gamma", "en", "s0")] * 300
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS nth")
    out = sorted(map(tuple, D.audit(docs, least, 4, block).collect()))
    assert out == audited(rows, least, 4)


def test_no_rows(spark):
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_beyond_a_long(spark):
    n, total, terms = 4 * 10**13, 9 * 10**15 + 7, 10**6
    got = spark.range(1).select(D.share(D.F.lit(n), D.F.lit(total), D.F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)
