import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitor
from tidemark.session import table
from tidemark.streaming import flows

SF = "/root/testdata/sf0.001"


def day(text):
    return datetime.datetime.fromisoformat(text)


@pytest.fixture
def events(spark, tmp_path):
    """The events as a stream of files, in the order of their time."""
    rows = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_closed_windows_equal_those_of_the_table(spark, tmp_path, events):
    rows, stream = events
    out = flows.windowed(flows.in_time(stream, "ts"), "ts", "event_type", "value", "1 hour")
    flows.run_once(out, f"{tmp_path}/state", path=f"{tmp_path}/out")
    got = {(r["event_type"], r["start"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["event_type"], r["start"]): r["n"] for r in flows.windowed(rows, "ts", "event_type", "value", "1 hour").collect()}
    # A window is given out once, when the watermark has passed it; rows of one file later than that are late.
    assert got and set(got) <= set(want) and all(n <= want[k] for k, n in got.items())


def test_the_ledger_is_gapless_over_batches_and_retries(spark, tmp_path, events):
    rows, stream = events
    write = flows.ledger_writer(f"{tmp_path}/ledger", ["ts", "event_id"])
    flows.run_once(stream.select("ts", "event_id"), f"{tmp_path}/state", write)
    first = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/ledger").select("seq", "event_id").collect()))
    assert [s for s, _ in first] == list(range(1, rows.count() + 1))
    again = spark.createDataFrame(spark.read.parquet(f"{tmp_path}/ledger/batch=2").select("ts", "event_id").collect())
    write(again, 2)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/ledger").select("seq", "event_id").collect())) == first


def test_late_rows_go_to_the_archive(spark):
    rows = spark.createDataFrame([(1, day("2024-01-01"), day("2024-01-02")), (2, day("2024-01-01"), day("2024-01-05")), (3, None, day("2024-01-05"))], "id int, at timestamp, seen timestamp")
    today, late = flows.split_late(rows, "at", "seen")
    assert sorted(r["id"] for r in today.collect()) == [1, 3] and [r["id"] for r in late.collect()] == [2]


def test_the_machine_over_a_stream_equals_the_batch(spark, tmp_path):
    schema = "post string, kind string, action string, at timestamp_ntz, through timestamp_ntz, count int"
    posts = [("p1", "k", "announce", day("2024-01-01"), day("2024-01-02"), 1), ("p2", "k", "confirm", day("2024-01-02"), None, 1), ("p3", "k", "confirm", day("2024-01-03"), None, 1), ("p1", "k", "announce", day("2024-01-01"), None, 1), ("q1", "l", "announce", day("2024-01-01"), None, 2), ("q2", "l", "withdraw", day("2024-01-01T05:00:00"), None, 1)]
    df = spark.createDataFrame(posts, schema)
    want = sorted((r["event_id"], r["status"], r["withdrawn"]) for r in monitor.assemble(df).collect())
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            e = json.loads(r["event"])
            seen[e["event_id"]] = (e["event_id"], e["status"], e["withdrawn"])

    stream = monitor.stream_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    assert sorted(seen.values()) == want


def test_a_failure_between_data_and_manifest_leaves_no_gap_and_no_repeat(spark, tmp_path, events):
    rows, stream = events
    path, calls = f"{tmp_path}/ledger", []

    def commit(manifest, where):
        calls.append(where)
        if len(calls) == 2:
            raise OSError("lost before the manifest")
        manifest.write.mode("overwrite").json(where)

    write = flows.ledger_writer(path, ["ts", "event_id"], commit)
    with pytest.raises(Exception, match="lost before the manifest"):
        flows.run_once(stream.select("ts", "event_id"), f"{tmp_path}/state", write)
    # The second batch's rows are there, but nobody reads them, and the cursor has not moved.
    held = flows.committed(spark, path)
    assert held["batch"] == 0 and flows.read_ledger(spark, path).count() == held["rows"] == held["last_seq"] < spark.read.parquet(path).count()
    flows.run_once(stream.select("ts", "event_id"), f"{tmp_path}/state", write)
    got = sorted(map(tuple, flows.read_ledger(spark, path).select("seq", "event_id").collect()))
    assert [s for s, _ in got] == list(range(1, rows.count() + 1)) and len({e for _, e in got}) == rows.count()
    last = flows.committed(spark, path)
    assert (last["batch"], last["last_seq"]) == (2, rows.count())
    in_last = spark.read.parquet(f"{path}/batch=2").agg(F.max(F.struct("ts", "event_id")).alias("m")).first()["m"]
    assert json.loads(last["position"])["event_id"] == in_last["event_id"]


def test_a_batch_reads_one_manifest(spark, tmp_path):
    """Whatever came before: the rows of earlier batches may even be gone."""
    import shutil

    path = f"{tmp_path}/ledger"
    write = flows.ledger_writer(path, ["k"])
    for number in range(4):
        write(spark.range(5 * number, 5 * number + 5).withColumnRenamed("id", "k"), number)
        shutil.rmtree(f"{path}/batch={number - 1}", ignore_errors=True)
    write(spark.range(3).withColumnRenamed("id", "k").limit(0), 4)
    assert sorted(r["seq"] for r in spark.read.parquet(f"{path}/batch=3").collect()) == [16, 17, 18, 19, 20]
    assert tuple(flows.committed(spark, path)) == (4, 20, 0, '{"k":19}')


def plain_machine(posts):
    """The events of the machine that reads a kind from its first post to its last."""
    machines = {}
    for post, kind, action, at, through, count in sorted(posts, key=lambda p: (p[3], p[0])):
        machines.setdefault(kind, monitor.Machine(kind)).feed(post, action, at, through, count)
    return sorted((e["event_id"], e["status"], e["withdrawn"], str(e["through"]), tuple(e["posts"])) for m in machines.values() for e in m.events)


def random_posts(n, gap):
    import random

    import pandas as pd

    rng, at, out = random.Random(5), pd.Timestamp("2024-01-01"), []
    for k in range(n):
        at += pd.Timedelta(hours=rng.choice([0, 1, 3, gap]))
        through = at + pd.Timedelta(hours=rng.choice([-3, 2, 30])) if rng.random() < 0.3 else None
        out.append((f"p{k}", rng.choice("ab"), rng.choice(["announce", "progress", "confirm", "amend", "withdraw"]), at, through, rng.choice([1, 1, 2])))
    return out


SCHEMA = "post string, kind string, action string, at timestamp_ntz, through timestamp_ntz, count int"
plain = lambda posts: [(p, k, a, t.to_pydatetime(), u and u.to_pydatetime(), n) for p, k, a, t, u, n in posts]


def test_stretches_give_the_events_of_the_whole_kind(spark):
    posts = random_posts(300, 60)
    df = spark.createDataFrame(plain(posts), SCHEMA)
    got = sorted((r["event_id"], r["status"], r["withdrawn"], str(r["through"]), tuple(r["posts"])) for r in monitor.assemble(df).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in plain_machine(posts)]
    assert monitor.stretches(df).select("kind", "stretch").distinct().count() > 20


def test_state_stays_small_and_survives_a_restart(spark, tmp_path):
    """Five runs over one checkpoint: the events of the whole, with a state that does not grow."""
    posts = random_posts(400, 30)
    schema, seen, sizes = SCHEMA, {}, []

    def keep(batch, _):
        for r in batch.collect():
            e = json.loads(r["event"])
            seen[e["event_id"]] = (e["event_id"], e["status"], e["withdrawn"], tuple(e["posts"]))

    for k in range(5):
        spark.createDataFrame(plain(posts[80 * k : 80 * k + 80]), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = monitor.stream_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
    assert sorted(seen.values()) == [(e, s, w, p) for e, s, w, _, p in plain_machine(posts)]
    assert max(sizes[1:]) <= 2 * min(sizes[1:])
