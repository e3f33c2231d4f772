"""Best-fit packing of documents into fixed-length sequences by bin completion.

Documents become token pieces in Spark tasks. Lengths are at most the capacity, so the demand
is a histogram of at most `capacity` rows, however many documents there are. `fill` solves the
packing on that histogram, and pieces find their places by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import Scratch, need

#: Ranks within one length are counted in this many shares, so that a common length is dealt out.
SHARES = 64
#: Of a search: fillings of one item at most, fillings looked at for one total, nodes, how often
#: the unavoidable waste is worked out, and how much waste over the even part is taken early.
WIDTH, LOOKED, NODES, PRUNE_EVERY, ORDERS = 24, 40, 5_000, 4, (4.0, 3.0, 2.0)


def cut(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of each document.

    A document is the ids of its text (null: empty) and end_id. Only longer ones than capacity
    are cut; their first piece takes what is over, all others are full.
    """
    end, encoding = end_id.to_bytes(4, "little"), tokens.Encoding(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encoding.encode(text) + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % capacity or capacity
                    out.append((doc, piece, at, length, tokens.crc32(ids[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = need(docs, "doc_id", "text").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def reachable(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """For each place k, as the bits of a number: the sums up to room of items from sizes[k:]."""
    mask, sums = (1 << (room + 1)) - 1, [1] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        s, now = sizes[k], sums[k + 1]
        for _ in range(min(left[s], room // s)):
            more = (now | now << s) & mask
            if more == now:
                break
            now = more
        sums[k] = now
    return sums


def dominated(filling: tuple[int, ...], waste: int, left: dict[int, int], stock: int) -> bool:
    """Whether another filling could always take the place of this one.

    It could if an item left out, put in for some of the items (or none), still fits and holds as
    much as they do: what they leave goes wherever the larger item would have gone. stock: the
    sizes in left, as bits.
    """
    several, some = 0, 1
    for s in filling:
        several |= several << s | (some & ~1) << s
        some |= some << s
        if left[s] <= filling.count(s):
            stock &= ~(1 << s)
    if several & stock:
        return True
    # The sizes over a sum by 1 to waste, in doubling steps.
    over, done = some << 1, 1
    while done < waste:
        step = min(done, waste - done)
        over |= over << step
        done += step
    return waste > 0 and bool(over & stock)


def completions(sizes: list[int], left: dict[int, int], room: int, waste: int, most: int, looked: int = LOOKED) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings of room that waste no more than waste, the fullest first, and whether
    these are all.

    sizes: falling. For each total from room down, items are chosen largest first, only where the
    rest of the total can still be reached, so no branch is in vain. Up to most are returned, of
    up to looked for each total and four times as many together.
    """
    sums, stock = reachable(sizes, left, room), sum(1 << s for s in sizes if left[s])

    def exact(k: int, total: int, chosen: list[int]) -> Iterator[tuple[int, ...]]:
        if not total:
            yield tuple(chosen)
            return
        while k < len(sizes) and sums[k] >> total & 1:
            s = sizes[k]
            for m in range(min(left[s], total // s), 0, -1):
                if sums[k + 1] >> (total - m * s) & 1:
                    yield from exact(k + 1, total - m * s, chosen + [s] * m)
            k += 1

    found: list[tuple[int, ...]] = []
    whole, seen = True, 0
    for unused in range(min(waste, room) + 1):
        if not sums[0] >> (room - unused) & 1:
            continue
        if len(found) >= most or seen >= 4 * looked:
            return found, False
        for n, filling in enumerate(exact(0, room - unused, [])):
            if n == looked or len(found) == most:
                whole = False
                break
            seen += 1
            if not dominated(filling, unused, left, stock):
                found.append(filling)
    return found, whole


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by patterns: largest piece first, then the largest that still fits."""
    left = {s: n for s, n in counts.items() if n}
    out = []
    while left:
        pattern, room = [], capacity
        for s in sorted(left, reverse=True):
            k = min(left[s], room // s)
            pattern += [s] * k
            room -= s * k
        need_of = {s: pattern.count(s) for s in set(pattern)}
        times = min(left[s] // k for s, k in need_of.items())
        out.append((tuple(pattern), times))
        for s, k in need_of.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def bins(plan: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(n for _, n in plan)


def least_waste(left: dict[int, int], capacity: int) -> int:
    """Waste that no packing avoids: of each item over half the capacity, what its bin leaves
    even if it has all smaller items to choose from; beside it, that of the bound by sums."""
    small = sorted((s for s in left if 2 * s <= capacity), reverse=True)
    sums = reachable(small, left, capacity)[0]
    lost = 0
    for s, n in left.items():
        if 2 * s > capacity:
            room = capacity - s
            lost += n * (room + 1 - (sums & (1 << (room + 1)) - 1).bit_length())
    return lost


def bound_of(counts: dict[int, int], capacity: int) -> int:
    """Bins that every packing needs at least."""
    left = {s: n for s, n in counts.items() if n}
    return -(-(sum(s * n for s, n in left.items()) + least_waste(left, capacity)) // capacity)


def search(counts: dict[int, int], capacity: int, target: int, loose: float, nodes: int) -> tuple[list[tuple[tuple[int, ...], int]] | None, bool, int]:
    """A packing into target bins at most, or None, whether the search saw every case, and its nodes.

    Depth-first: the largest item left is completed by each of its undominated fillings in turn.
    First come those that waste up to loose times a bin's even part of the waste that is left and
    use the fewest items, which keeps small items for later, then the others, the fullest first.
    A filling is taken as often as stock and waste allow, then fewer times. A branch is cut when
    its waste and the waste that its rest can't avoid pass what target bins may waste.
    """
    left = {s: n for s, n in counts.items() if n}
    spare = target * capacity - sum(s * n for s, n in left.items())
    used, seen, whole = 0, 0, True

    def options() -> list[tuple[tuple[int, ...], int, int]]:
        nonlocal whole
        if spare < 0 or seen % PRUNE_EVERY == 0 and least_waste(left, capacity) > spare:
            return []
        top = max(left)
        room = capacity - top
        stock = {s: n - (s == top) for s, n in left.items()}
        sizes = sorted((s for s, n in stock.items() if n and s <= room), reverse=True)
        found, all_seen = completions(sizes, stock, room, spare, WIDTH)
        whole &= all_seen
        even = loose * spare / max(1, target - used) + 1
        ranked = sorted(found, key=lambda f: (room - sum(f) > even, len(f) if room - sum(f) <= even else 0, room - sum(f), [-x for x in f]))
        out = []
        for f in ranked:
            pattern, waste = (top, *f), room - sum(f)
            times = min(left[s] // pattern.count(s) for s in set(pattern))
            times = min(times, spare // waste) if waste else times
            out += [(pattern, waste, t) for t in sorted({times, times // 2, 1} - {0}, reverse=True)]
            # Between a half and all, and one, other numbers are left out.
            whole &= times <= 3
        # Every filling as often as it goes, then fewer times.
        return sorted(out, key=lambda o: o[2] < max(p[2] for p in out if p[0] == o[0]))

    path: list[tuple[tuple[int, ...], int, int]] = []
    frames = [options()] if left else []
    while frames:
        if not frames[-1] or seen >= nodes:
            if seen >= nodes:
                return None, False, seen
            frames.pop()
            if path:
                pattern, waste, times = path.pop()
                used, spare = used - times, spare + waste * times
                for s in pattern:
                    left[s] = left.get(s, 0) + times
            continue
        pattern, waste, times = frames[-1].pop(0)
        for s in pattern:
            left[s] -= times
            if not left[s]:
                del left[s]
        path.append((pattern, waste, times))
        used, spare, seen = used + times, spare - waste * times, seen + 1
        if not left:
            return [(p, t) for p, _, t in path], whole, seen
        frames.append(options())
    return None, whole, seen


def fill(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, together holding every piece once.

    The first incumbent is the best fit of the whole. Branch-and-bound searches, in several
    orders, then look for one bin fewer, until the bound is met, a search has seen every case, or
    nodes are used up, half of what is left for each search; so the work does not grow with the
    documents.
    """
    left = {s: n for s, n in counts.items() if n}
    best, bound = best_fit(left, capacity), bound_of(left, capacity)
    for loose in ORDERS:
        while bins(best) > bound:
            found, whole, seen = search(left, capacity, bins(best) - 1, loose, -(-nodes // 2))
            nodes -= seen
            if found is None:
                bound = bins(best) if whole else bound
                break
            best = found
    return best


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each run of equal sizes in a pattern: length, first and last rank, items a bin, the
    pattern's first bin, and the offset of the run's first item."""
    taken: dict[int, int] = {}
    out, first_bin = [], 0
    for pattern, times in plan:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            start = taken.get(s, 0)
            out.append((s, start, start + k * times, k, first_bin, offset))
            taken[s] = start + k * times
            offset += s * k
        first_bin += times
    return out


def rank_within(pieces: DataFrame, key: str, order: list[str], shares: int = SHARES) -> DataFrame:
    """Adds rank_no, from 0 within each key, by shares of the key's rows and then by order.

    The key's rows are dealt into shares by a hash of the order columns; a window numbers each
    share, and shares start after the rows of those before them. No task sees a whole key.
    """
    dealt = pieces.withColumn("share_no", F.pmod(F.xxhash64(*order), F.lit(shares)).cast("int"))
    sums = dealt.groupBy(key, "share_no").count()
    before = sums.withColumn("share_start", F.sum("count").over(Window.partitionBy(key).orderBy("share_no").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(key, "share_no", F.coalesce("share_start", F.lit(0)).alias("share_start"))
    numbered = dealt.withColumn("in_share", F.row_number().over(Window.partitionBy(key, "share_no").orderBy(*order)) - 1)
    return numbered.join(before, [key, "share_no"]).withColumn("rank_no", F.col("share_start") + F.col("in_share")).drop("share_no", "share_start", "in_share")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece with its sequence_id and its offset there, in as few sequences as are found.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is an empty
    document of one token. Rows of equal id and text are packed as many times as they occur, a
    null id like any other. No documents give no sequences.
    """
    spark = docs.sparkSession
    pieces = Scratch(spark).save(cut(docs, path, capacity, end_id))
    # At most `capacity` rows, whatever the input.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = places(fill(counts, capacity))
    schema = "length long, first_rank long, last_rank long, a_bin long, first_bin long, first_offset long"
    plan = spark.createDataFrame(table, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "last_rank", "a_bin", "first_bin", "first_offset"))).alias("runs"))
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    # A length has a run for each pattern that uses it; the table is bounded by the solver's steps.
    placed = ranked.join(F.broadcast(plan), "length").withColumn("run", F.filter("runs", lambda r: (r["first_rank"] <= F.col("rank_no")) & (F.col("rank_no") < r["last_rank"]))[0])
    nth = F.col("rank_no") - F.col("run.first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first_bin") + F.floor(nth / F.col("run.a_bin"))).cast("long").alias("sequence_id"),
        (F.col("run.first_offset") + F.pmod(nth, F.col("run.a_bin")) * F.col("length")).cast("long").alias("offset"),
    )
