"""Announcements to events: a state machine for each kind, in batch and in a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

# Hours that an announcement stays open beyond its time, and that part two confirmations.
GRACE_HOURS, DEFAULT_HOURS, ANEW_HOURS, LIKELY_HOURS = 12, 24, 6, 6
EVENTS = "event_id string, kind string, status string, created_at timestamp_ntz, through timestamp_ntz, confirmed_at timestamp_ntz, in_progress boolean, withdrawn boolean, posts array<string>"
HOUR = pd.Timedelta(hours=1)


def open_until(e: dict) -> pd.Timestamp:
    """The last time at which a post can still be about an event."""
    return (e["through"] if e["through"] is not None else e["created_at"] + DEFAULT_HOURS * HOUR) + GRACE_HOURS * HOUR


class Machine:
    """The events of one kind, fed posts in the order of their times. The same post changes nothing
    a second time."""

    def __init__(self, kind: str, events: list[dict] | None = None, seen: list[str] | None = None):
        self.kind, self.events, self.seen = kind, events or [], set(seen or [])

    def target(self, at: pd.Timestamp, also_confirmed: bool) -> dict | None:
        for e in self.events[::-1]:
            if not e["withdrawn"] and at <= open_until(e) and (e["status"] == "announced" or also_confirmed):
                return e
        return None

    def new(self, post: str, at, status: str, through, nth: int = 1) -> dict:
        e = {"event_id": f"{self.kind}-{post}-{nth}", "kind": self.kind, "status": status, "created_at": at, "through": through, "confirmed_at": at if status == "confirmed" else None, "in_progress": False, "withdrawn": False, "posts": [post]}
        self.events.append(e)
        return e

    def feed(self, post: str, action: str, at: pd.Timestamp, through=None, count: int = 1) -> None:
        if post in self.seen:
            return
        self.seen.add(post)
        through = None if through is None or pd.isna(through) else through
        e = self.target(at, action in ("confirm", "amend", "withdraw"))
        if action in ("announce", "progress"):
            if e is None:
                made = [self.new(post, at, "announced", through, n) for n in range(1, (count if action == "announce" else 1) + 1)]
                made[0]["in_progress"] = action == "progress"
                return
            e["through"] = through if through is not None else e["through"]
            e["in_progress"] |= action == "progress"
        elif action == "confirm":
            if e is None or (e["status"] == "confirmed" and at - e["confirmed_at"] > ANEW_HOURS * HOUR):
                for n in range(1, (count if e is None else 1) + 1):
                    self.new(post, at, "confirmed", through, n)
                return
            if e["status"] == "announced":
                e.update(status="confirmed", confirmed_at=at, in_progress=False)
        elif e is None:
            return
        elif action == "amend":
            e["through"] = through if through is not None and e["status"] == "announced" else e["through"]
        elif action == "withdraw":
            e["withdrawn"] = True
        e["posts"].append(post)


def stretches(posts: DataFrame) -> DataFrame:
    """posts with `stretch`: their place in the parts of a kind that share no event.

    A part begins where no event of an earlier post can be open any more. Posts are dealt by kind
    and day; what is open longest is carried from day to day first, so no task reads a kind.
    """
    reach = F.coalesce("through", F.col("at") + F.expr(f"INTERVAL {DEFAULT_HOURS} HOURS")) + F.expr(f"INTERVAL {GRACE_HOURS} HOURS")
    # A time in the past doesn't close what the same post opens.
    rows = posts.withColumn("_day", F.to_date("at")).withColumn("_reach", F.greatest(reach, F.col("at")))
    days = rows.groupBy("kind", "_day").agg(F.max("_reach").alias("_most"))
    before = Window.partitionBy("kind").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("_open", F.max("_most").over(before)).drop("_most")
    in_day = Window.partitionBy("kind", "_day").orderBy("at", "post").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, ["kind", "_day"])
    so_far = F.greatest(F.col("_open"), F.max("_reach").over(in_day))
    marked = joined.withColumn("_new", F.when(so_far.isNull() | (F.col("at") > so_far), 1).otherwise(0))
    firsts = marked.groupBy("kind", "_day").agg(F.sum("_new").alias("_n"))
    counted = firsts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.sum("_new").over(Window.partitionBy("kind", "_day").orderBy("at", "post").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.join(counted, ["kind", "_day"]).withColumn("stretch", F.col("_from") + nth).drop("_day", "_reach", "_open", "_new", "_from")


def assemble(posts: DataFrame) -> DataFrame:
    """The events that posts make. posts: post, kind, action, at, through, count.

    Actions: announce, progress, confirm, amend, withdraw. Of a post that comes twice the first
    counts. Each stretch of a kind is read as a sorted stream by itself, so memory holds its
    events, not its posts, and a kind with a long history is spread over its stretches.
    """
    names = [f.split()[0] for f in EVENTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, part = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if machine is None or (r.kind, r.stretch) != part:
                    if machine is not None:
                        yield pd.DataFrame(machine.events, columns=names)
                    machine, part = Machine(r.kind), (r.kind, r.stretch)
                machine.feed(r.post, r.action, r.at, r.through, int(r.count))
        if machine is not None:
            yield pd.DataFrame(machine.events, columns=names)

    nth = F.row_number().over(Window.partitionBy("kind", "post").orderBy("at", "action"))
    once = posts.select("post", "kind", "action", "at", "through", F.col("count").alias("count")).withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return stretches(once).repartition("kind", "stretch").sortWithinPartitions("kind", "stretch", "at", "post").mapInPandas(run, EVENTS)


def shown_status(status: Column, in_progress: Column, through: Column, now: Column) -> Column:
    """What readers see: a stated time that has passed is expired, then likely completed."""
    late = F.when(now < through, "announced").when(now < through + F.expr(f"INTERVAL {LIKELY_HOURS} HOURS"), "expired_unconfirmed").otherwise("likely_completed")
    return F.when(status == "confirmed", "confirmed").when(in_progress, "in_progress").when(through.isNull(), "announced").otherwise(late)


class OpenEvents(StatefulProcessor):
    """The open events of a kind as a list, and the posts seen as a map, until the watermark has
    passed what they could still change; a timer at the next such time clears them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "event string")
        self.seen = handle.getMapState("seen", "post string", "at timestamp_ntz")

    def held(self) -> list[dict]:
        return [json.loads(row[0], object_hook=_timed) for row in self.open.get()] if self.open.exists() else []

    def keep(self, events: list[dict], watermark: int) -> None:
        """Put back what may still change after the watermark, and wake when the first is closed."""
        mark = pd.Timestamp(watermark, unit="ms")
        left = [e for e in events if not e["withdrawn"] and open_until(e) >= mark]
        if left:
            self.open.put([(json.dumps(e, default=str),) for e in left])
        elif self.open.exists():
            self.open.clear()
        ends = [open_until(e) for e in left]
        for post, at in list(self.seen.iterator()) if self.seen.exists() else []:
            if at[0] < mark:
                self.seen.removeKey(post)
            else:
                ends.append(at[0])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ends:
            self.handle.registerTimer(max(int(pd.Timestamp(min(ends)).timestamp() * 1000) + 1, watermark + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        machine, told = Machine(key[0], self.held()), {}
        for r in pd.concat(list(rows)).sort_values(["at", "post"]).itertuples(index=False):
            if not self.seen.containsKey((r.post,)):
                self.seen.updateValue((r.post,), (r.at.to_pydatetime(),))
                before = {e["event_id"]: json.dumps(e, default=str) for e in machine.events}
                machine.feed(r.post, r.action, r.at, r.through, int(r.count))
                told |= {e["event_id"]: e for e in machine.events if json.dumps(e, default=str) != before.get(e["event_id"])}
        self.keep(machine.events, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"kind": [key[0]] * len(told), "event": [json.dumps(e, default=str) for e in told.values()]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.keep(self.held(), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def _timed(e: dict) -> dict:
    return {k: pd.Timestamp(v) if k in ("created_at", "through", "confirmed_at") and v else v for k, v in e.items()}


def stream_events(posts: DataFrame, late: str = "48 hours") -> DataFrame:
    """The same machine over a stream: kind and each event that a batch of posts changed, as JSON.

    Posts later than `late` behind the newest are left out. State holds open events and posts not
    yet behind the watermark only; it needs the state store of RocksDB, which the session names.
    """
    timed = posts.withColumn("_at", F.col("at").cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy("kind").transformWithStateInPandas(OpenEvents(), "kind string, event string", "update", "eventtime")
