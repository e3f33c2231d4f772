"""Compares a query with its SQL on the same tables, without regard to the order of rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'; SET threads = 2")
    for name in TABLES:
        where = f"{sf_dir}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}{'/*' if Path(where).is_dir() else ''}')")
    return db


def plain(v):
    """A value in a form that both engines share; floats to nine digits."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal | float):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    with connect(sf_dir) as db:
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        want = rows(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), f"{len(got)} rows, {len(want)} expected"
    unlike = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not unlike, f"{len(unlike)} of {len(got)} rows differ, first {unlike[0]}"
