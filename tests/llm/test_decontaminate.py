import random
import re

import numpy as np

from tidemark.llm import common
from tidemark.llm import decontaminate as dc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items, threshold=0.8):
    out = {}
    for d, t in docs:
        for i, x in items:
            q = grams(x)
            n = len(q & grams(t))
            if q and n >= threshold * len(q):
                out[d, i] = max(n, out.get((d, i), 0))
    return out


def words(rng, n, tag=""):
    return " ".join(f"{tag}{rng.randrange(5000)}" for _ in range(n))


def case():
    rng = random.Random(4)
    items = [(k, words(rng, rng.choice([5, 6, 8, 14, 40, 120]), f"b{k}x")) for k in range(60)] + [(100, None), (101, "too few words"), (102, ""), (3, "again " + words(rng, 20))]
    docs = []
    for k in range(200):
        text = words(rng, rng.choice([0, 3, 30, 400, 3000]), "d").split(" ")
        for _ in range(rng.randrange(3)):
            item = items[rng.randrange(60)][1].upper().split(" ")
            if rng.random() < 0.5:
                item = item[: max(1, int(len(item) * rng.uniform(0.6, 1)))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        docs.append((k, " ".join(text)))
    hot = items[7][1]
    docs += [(300 + k, f"own{k} {hot} tail{k}") for k in range(150)] + [(600, None), (601, ""), (None, items[9][1]), (5, docs[5][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as k", "2 as h", "3 as item_id")
    # An id that two items share stands for both, so each is compared by itself.
    single = [x for x in items if x[0] != 3]
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in dc.contained(frame, spark.createDataFrame(single, "item_id long, text string")).collect()}
    want = brute(docs, single)
    assert got == want and len(want) > 200
    left = dc.decontaminate(frame, spark.createDataFrame(single, "item_id long, text string"))
    assert left.columns == frame.columns
    assert sorted((r["doc_id"] for r in left.collect())) == sorted(d for d, _ in docs if d is not None and d not in {a for a, _ in want})


def test_join_by_shuffle(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(common.fits, "__defaults__", (-1,))
    monkeypatch.setattr(common.small, "__defaults__", (-1,))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:60], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in dc.contained(*frames).collect()} == brute(docs, items[:60])


def test_sketch_recall_without_verification():
    """Of random sets, how often no least hash of a contained part meets, and how much is kept."""
    rng = np.random.default_rng(5)

    def least(hashes, bits):
        hashes = np.sort(hashes)
        return set(hashes[np.r_[True, np.diff(hashes >> np.uint64(64 - bits)) > 0]].tolist())

    kept = {}
    for n_item in (1, 9, 17, 40, 120, 500):
        for k in (6, 9, 12):
            if 2**k < n_item:
                continue
            bits, missed, shares = dc.bits_for(k, n_item), 0, []
            for _ in range(200):
                item = rng.integers(0, 2**63, n_item, dtype=np.uint64) * np.uint64(2)
                doc = np.concatenate([item[: -(-4 * n_item // 5)], rng.integers(0, 2**63, 2**k - -(-4 * n_item // 5), dtype=np.uint64)])
                mine = least(doc, bits)
                missed += not mine & least(item, bits)
                shares.append(len(mine) / len(doc))
            kept[n_item, k] = np.mean(shares)
            assert missed <= 1
    # Longer items need less of a long document: a fifteenth of it for 120 shingles.
    assert kept[17, 12] < 0.7 and kept[40, 12] < 0.35 and kept[120, 12] < 0.12 and kept[500, 12] < 0.04


def test_null_ids_are_not_one_document(spark):
    """A clean row without an id stays though another one without an id holds an item."""
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, "nothing of the kind in here at all"), (1, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert sorted((r["text"] or "") for r in dc.decontaminate(docs, items).collect()) == ["", "nothing of the kind in here at all"]


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert dc.contained(docs.limit(0), items).count() == 0
    assert dc.contained(docs, items.limit(0)).count() == 0
    assert dc.decontaminate(docs, items.limit(0)).count() == 1
    assert dc.contained(docs, items).count() == 1
