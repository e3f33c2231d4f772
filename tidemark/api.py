"""The read interface: validated arguments, filters that push down, pages by cursor."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators import publish as P
from tidemark.operators import relational as R
from tidemark.operators import stories as S

MODES, WINDOWS, ORDERS = ("all", "selected"), {"24h": 24, "7d": 168}, {"published": "sort_at", "discovered": "discovered_at"}
MOST, SNAPSHOT_MOST, CHANGES_MOST = 100, 1000, 100


class BadRequest(ValueError):
    """An argument that is unknown, of the wrong kind, or out of its range."""


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    cursor: str | None


def one_of(name: str, value, allowed):
    if value is not None and value not in allowed:
        raise BadRequest(f"{name} must be one of {', '.join(map(str, allowed))}")
    return value


def between(name: str, value: int, low: int, high: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise BadRequest(f"{name} must be a whole number from {low} to {high}")
    return value


def _mark(query: dict) -> str:
    return hashlib.sha256(json.dumps(query, sort_keys=True, default=str).encode()).hexdigest()[:12]


def encode_cursor(values: list, query: dict) -> str:
    """A cursor that only the same query takes."""
    body = json.dumps([_mark(query), *values], default=str, separators=(",", ":"))
    return "c1." + base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, query: dict) -> list:
    try:
        if not cursor.startswith("c1."):
            raise ValueError
        body = cursor[3:]
        mark, *values = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    except (ValueError, TypeError) as e:
        raise BadRequest("the cursor can't be read") from e
    if mark != _mark(query):
        raise BadRequest("the cursor belongs to another query")
    return values


def pool(publications: DataFrame, now: Column, mode: str = "all") -> DataFrame:
    """What may be shown now: listed rows, or the selected ones among them."""
    rows = publications.where(P.listed(F.col("visibility"), F.col("selected"), F.col("visible_after"), now))
    return rows.where("selected") if mode == "selected" else rows


def items(publications: DataFrame, now: Column, mode: str = "all", window: str | None = None, by: str = "published", categories: list[str] | None = None, role: str | None = None, q: str | None = None, limit: int = 50, cursor: str | None = None) -> Page:
    """The latest publications under the filters, and a cursor if there are more.

    publications: id, visibility, selected, visible_after, category, roles, title, search_text,
    sort_at, discovered_at. Only narrow columns are sorted; the page's rows alone are read in full.
    """
    one_of("mode", mode, MODES), one_of("window", window, WINDOWS), one_of("by", by, ORDERS), between("limit", limit, 1, MOST)
    if q is not None and not 2 <= len(q) <= 200:
        raise BadRequest("q must have 2 to 200 characters")
    query = {"mode": mode, "window": window, "by": by, "categories": categories, "role": role, "q": q}
    at = ORDERS[by]
    rows = pool(publications, now, mode)
    if window:
        rows = rows.where(F.col(at).between(now - F.expr(f"INTERVAL {WINDOWS[window]} HOURS"), now))
    if categories:
        rows = rows.where(F.col("category").isin(categories))
    if role:
        rows = rows.where(F.array_contains("roles", role))
    for term in S.search_terms(q) if q else []:
        rows = rows.where(F.contains("search_text", F.lit(term)))
    after = tuple(decode_cursor(cursor, query)) if cursor else None
    page = R.keyset_page(rows.select("id", at), [at, "id"], after, limit).collect()
    ids = [r["id"] for r in page[:limit]]
    found = {r["id"]: r for r in publications.where(F.col("id").isin(ids)).collect()} if ids else {}
    more = encode_cursor([page[limit - 1][at], page[limit - 1]["id"]], query) if len(page) > limit else None
    return Page([found[i] for i in ids], more)


def snapshot(ledger: DataFrame, members: DataFrame, now: Column, n: int = SNAPSHOT_MOST) -> tuple[int, DataFrame]:
    """The watermark now, and the rows of the set as of it, n at most."""
    between("n", n, 1, SNAPSHOT_MOST)
    mark = P.watermark(ledger, now).first()[0]
    return mark, P.snapshot(ledger, F.lit(mark), members).orderBy("seq").limit(n)


def changes(ledger: DataFrame, cursor: int, now: Column, n: int = CHANGES_MOST) -> tuple[int, list[Row]]:
    """The next cursor, and the n changes at most that follow the cursor and may be seen now."""
    between("cursor", cursor, 0, 2**62), between("n", n, 1, CHANGES_MOST)
    mark = P.watermark(ledger, now).first()[0]
    rows = P.changes_after(ledger, cursor, F.lit(mark), n).collect()
    return (rows[-1]["seq"] if len(rows) == n else max(cursor, mark)), rows
