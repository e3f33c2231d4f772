import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import api



def now():
    return F.lit("2024-01-10").cast("timestamp")


@pytest.fixture(scope="module")
def pubs(spark):
    at = "timestamp'2024-01-01' + make_dt_interval(0, cast(id div 2 as int))"
    return spark.range(100).selectExpr("id", "if(id % 10 = 0, 'withdrawn', 'public') AS visibility", "id % 2 = 0 AS selected", f"{at} AS visible_after", "if(id % 3 = 0, 'a', 'b') AS category", "array('r1') AS roles", "'T' AS title", "concat('text ', id) AS search_text", f"{at} AS sort_at", f"{at} AS discovered_at").cache()


def test_pages_follow_each_other_without_gap(pubs):
    seen, cursor = [], None
    while True:
        page = api.items(pubs, now(), limit=17, cursor=cursor)
        seen += [r["id"] for r in page.rows]
        cursor = page.cursor
        if cursor is None:
            break
    assert seen == sorted((i for i in range(100) if i % 10), key=lambda i: (i // 2, i), reverse=True)


def test_filters(pubs):
    got = api.items(pubs, now(), mode="selected", categories=["a"], q="Text 1", role="r1", limit=100)
    assert {r["id"] for r in got.rows} == {i for i in range(100) if i % 10 and i % 6 == 0 and "1" == str(i)[0]}
    assert api.items(pubs, now(), window="24h").rows == []


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"limit": 0}, {"limit": True}, {"q": "a"}, {"window": "1y"}, {"cursor": "c1.@@"}, {"cursor": "zz"}])
def test_bad_arguments(pubs, bad):
    with pytest.raises(api.BadRequest):
        api.items(pubs, now(), **bad)


def test_a_cursor_is_bound_to_its_query(pubs):
    cursor = api.items(pubs, now(), limit=2).cursor
    with pytest.raises(api.BadRequest, match="another query"):
        api.items(pubs, now(), limit=2, q="text", cursor=cursor)


def test_ledger_reads(spark):
    at = datetime.datetime(2024, 1, 5)
    later = datetime.datetime(2024, 2, 5)
    ledger = spark.createDataFrame([(1, "a", "upsert", at), (2, "b", "upsert", at), (3, "a", "remove", at), (4, "c", "upsert", later), (5, "b", "upsert", at)], "seq long, key string, op string, visible_at timestamp")
    mark, rows = api.snapshot(ledger, ledger.select("key"), now())
    assert mark == 3 and [r["key"] for r in rows.collect()] == ["b"]
    assert [(c, [r["seq"] for r in rows]) for c, rows in (api.changes(ledger, 0, now(), 2), api.changes(ledger, 2, now(), 2), api.changes(ledger, 3, now()))] == [(2, [1, 2]), (3, [3]), (3, [])]
