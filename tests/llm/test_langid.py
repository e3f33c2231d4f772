import random
import zlib

import pytest

from tidemark.llm import langid

SCHEMA = "doc_id long, text string, lang string"
WORDS = {
    "en": "the and of to in is that it was for with on are this be have from".split(),
    "fr": "le la les des est une dans que pour qui avec sur pas être été où".split(),
    "de": "der die das und ist nicht mit ein eine für auf sich über größe".split(),
}


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(WORDS))
        out.append((k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 80))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as nth")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    unseen = [(k, lang) for k, _, lang in rows if got[k]["held_out"]]
    assert len(unseen) > 60 and sum(got[k]["lang_pred"] == lang for k, lang in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(300)
    hidden = [(k, t, "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in rows]
    a = sorted(map(tuple, langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()))
    b = sorted(map(tuple, langid.identify(spark.createDataFrame(hidden, SCHEMA)).collect()))
    assert a == b


def test_odd_texts_and_rejection(spark):
    odd = [(900, None, "en"), (901, "", None), (902, "123 !? 45", "en"), (903, "the and of " * 20_000, None), (None, "und die das mit", "de"), (904, "qzx qqz zzxq xqz qzzx " * 9, None), (3, "twice of the", "en"), (3, "twice of the", "en")]
    docs = spark.createDataFrame(corpus(200) + odd, SCHEMA)
    got = {}
    for r in langid.identify(docs).collect():
        got.setdefault(r["doc_id"], r)
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and got[902]["score"] == 0
    assert got[903]["lang_pred"] == "en" and not got[903]["rejected"]
    assert got[None]["lang_pred"] == "de" and got[None]["held_out"] is False
    assert got[904]["rejected"] and got[904]["lang_pred"] in WORDS
    assert langid.identify(docs).count() == 208


@pytest.mark.parametrize("rows", [[], [(1, "some text", None)], [(1, None, "en")]])
def test_nothing_to_learn(spark, rows):
    out = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)] * len(rows)


def test_sample_is_bounded(spark):
    rows = corpus(300)
    # One id three thousand times with one text, one with a thousand texts: neither is more than its share.
    rows += [(5, "one text of one id", "en")] * 3000 + [(7, f"the text {k} of one id", "en") for k in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["count"] for r in langid.sample(docs, 5).groupBy("lang").count().collect()) == [5, 5, 5]
    assert set(langid.fit(docs, per_language=5).languages) <= set(WORDS)


def test_characters_that_are_no_letters(spark):
    docs = spark.createDataFrame(corpus(100) + [(900, "½ ² Ⅷ 9", None), (901, "½ ² é", None)], SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert got[900] == "und" and got[901] != "und"
