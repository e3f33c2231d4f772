"""Loose dates against wanted times, in the forms that pages print."""

import datetime

import pytest

from tidemark.functions import dates as D

# text, the source's offset in hours, the time wanted in UTC.
CASES = [
    ("2031-03-08 07:45", 8, "2031-03-07 23:45:00"), ("2031-03-08T07:45:30", 8, "2031-03-07 23:45:30"), ("2031/3/8 07:45", 8, "2031-03-07 23:45:00"), ("2031.3.8", 8, "2031-03-07 16:00:00"),
    ("2031年3月8日 07:45", 8, "2031-03-07 23:45:00"), ("2031年3月8日07:45:06", 8, "2031-03-07 23:45:06"), ("2031-03-08 07:45", -7, "2031-03-08 14:45:00"), ("2031年3月8日", 8, "2031-03-07 16:00:00"),
    ("2031-03-08", 8, "2031-03-08 00:00:00"), ("2031-3-8", 8, "2031-03-07 16:00:00"), ("更新：2031-03-08 作者：某", 8, "2031-03-07 16:00:00"), ("10:30 2031-03-08", 8, "2031-03-07 16:00:00"),
    ("2031-03-08T07:45:00Z", 8, "2031-03-08 07:45:00"), ("2031-03-08T07:45:00.250+09:00", 8, "2031-03-07 22:45:00.250"), ("2031-03-08T07:45:00.5-0700", 8, "2031-03-08 14:45:00.500"), ("2031-03-08 07:45 UTC", 8, "2031-03-08 07:45:00"),
    ("Sat, 26 Sep 2026 10:00:00 +0000", 8, "2026-09-26 10:00:00"), ("Sat, 26 Sep 2026 10:00:00 GMT", 8, "2026-09-26 10:00:00"), ("Sat, 08 Mar 2031 07:45:00 +0230", -7, "2031-03-08 05:15:00"), ("Sat Mar 08 2031 07:45:00 GMT+0800 (Some Time)", 0, "2031-03-07 23:45:00"),
    ("Sep 26, 2026 10:30", 8, "2026-09-26 02:30:00"), ("Mar. 8, 2031 10:30 PM", 8, "2031-03-08 14:30:00"), ("8 March 2031 12:05 am", 0, "2031-03-08 00:05:00"), ("Saturday, March 8th, 2031", 0, "2031-03-08 00:00:00"),
    ("26 Oct 26", 8, "2026-10-25 16:00:00"), ("8 Mar, 99", 0, "1999-03-08 00:00:00"), ("Mar 2031", 8, "2031-02-28 16:00:00"), ("3/8/2031", 0, "2031-03-08 00:00:00"), ("3-8-2031", 0, "2031-03-08 00:00:00"), ("Sept 2, 2031", 0, "2031-09-02 00:00:00"), ("  8th of March 2031 ", 0, "2031-03-08 00:00:00"),
]
NONE = [None, "", "03-08", "3/8", "Mar 8", "8 March", "Sept 2", "03-08 14:30", "03-08 10:00 +0800", "03-08 10:00Z", "Mar 8 10:00 GMT", "Mar 8 10:00 GMT+0800", "Page 3", "12", "2031", "第3页", "Q3", "v2.3", "10:30", "N/A", "yesterday", "2031-13-45", "2031-02-30", "2031-03-08 25:00", "Marketing 3"]


@pytest.mark.parametrize("offset", sorted({o for _, o, _ in CASES}))
def test_forms_of_dates(spark, offset):
    cases = [(t, w) for t, o, w in CASES if o == offset]
    out = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", D.loose_date(D.F.col("t"), offset).alias("d")).collect()
    got = {cases[r["k"]][0]: r["d"] for r in out}
    assert got == {t: datetime.datetime.fromisoformat(w) for t, w in cases}


def test_no_dates(spark):
    out = spark.createDataFrame([(t,) for t in NONE], "t string").select("t", D.loose_date(D.F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in out} == dict.fromkeys(NONE)
