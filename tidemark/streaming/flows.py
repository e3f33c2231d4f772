"""Event-time flows that run alike over a stream and over a table.

Each function takes a frame that may be streaming. State is bounded by the watermark: rows later
than LATE after the latest event time seen leave the flow and belong to the archive branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational as R

# How late rows may be, how far ahead a clock may run, and how long a post waits.
LATE, AHEAD, WAIT = "48 hours", "1 hour", "48 hours"


def in_time(rows: DataFrame, at: str, now: Column | None = None) -> DataFrame:
    """rows without those dated more than AHEAD past `now` (default: no test), under the watermark."""
    kept = rows if now is None else rows.where(F.col(at) <= now + F.expr(f"INTERVAL {AHEAD}"))
    return kept.withWatermark(at, LATE) if rows.isStreaming else kept


def split_late(rows: DataFrame, at: str, seen: str) -> tuple[DataFrame, DataFrame]:
    """Rows for today, and those that were already older than LATE when they were first seen."""
    late = F.coalesce(F.col(seen) - F.col(at) > F.expr(f"INTERVAL {LATE}"), F.lit(False))
    return rows.where(~late), rows.where(late)


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: in a stream within the watermark, so that remembered keys don't pile up."""
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def windowed(rows: DataFrame, at: str, key: str, weight: str, length: str, step: str | None = None) -> DataFrame:
    """key, start, end, n, total for each window of a length, every step (default: its length)."""
    out = rows.groupBy(F.window(at, length, step or length), key).agg(F.count("*").alias("n"), F.sum(weight).alias("total"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(rows: DataFrame, at: str, key: str, gap: str) -> DataFrame:
    """key, start, end, n of each run of rows that are closer than the gap; end is the last row plus it."""
    out = rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def waiting(posts: DataFrame, reports: DataFrame, key: str, post_at: str, report_at: str) -> DataFrame:
    """posts joined to the report they quote, if that is seen within WAIT before or after the post.

    posts and reports share no other column names than the key. Both sides of a stream keep rows
    only as long as a partner may still come.
    """
    report = reports.withColumnRenamed(key, "_key")
    near = F.col(report_at).between(F.col(post_at) - F.expr(f"INTERVAL {WAIT}"), F.col(post_at) + F.expr(f"INTERVAL {WAIT}"))
    return posts.join(report, (F.col(key) == F.col("_key")) & near).drop("_key")


def budgets(rows: DataFrame, at: str, key: str, limits: dict[str, int]) -> DataFrame:
    """key, span, start, used, allowed, wait_seconds: use of each span's budget, and how long a call
    at the window's last row had to wait for its end where nothing is left."""
    out = None
    for span, allowed in limits.items():
        used = rows.groupBy(F.window(at, span), key).agg(F.count("*").alias("used"), F.max(at).alias("_last"))
        wait = F.when(F.col("used") >= allowed, F.timestamp_diff("SECOND", F.col("_last"), F.col("window.end"))).otherwise(0)
        part = used.select(key, F.lit(span).alias("span"), F.col("window.start").alias("start"), "used", F.lit(allowed).alias("allowed"), wait.alias("wait_seconds"))
        out = part if out is None else out.unionByName(part)
    return out


COMMIT = "batch long, last_seq long, rows long, position string"


def _commits(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that have a manifest, in order, from one listing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    done = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(where) if "=" in f.getPath().getName() and done(f.getPath()))


def _commit(spark: SparkSession, path: str, number: int) -> Row:
    return spark.read.schema(COMMIT).json(f"{path}/_commits/batch={number}").first()


def committed(spark: SparkSession, path: str) -> Row | None:
    """batch, last_seq, rows and position (the greatest order as JSON) of the last whole batch of a
    ledger: where a reader or a source's cursor may go on from. None where there is none."""
    numbers = _commits(spark, path)
    return _commit(spark, path, numbers[-1]) if numbers else None


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger as far as it is committed: what a failed batch left behind is not read."""
    last = committed(spark, path)
    if last is None:
        raise ValueError(f"no ledger at {path}")
    return spark.read.parquet(path).where(F.col("batch") <= last["batch"])


def ledger_writer(path: str, order: list[str], commit: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each batch to a ledger with gapless numbers, exactly once.

    A batch's rows are written to its own folder first, over what a failed attempt left there; then
    its manifest (number, last seq, rows, position) by `commit`. The numbers go on from the
    manifest before it, the only thing read of earlier batches, and a batch that has a manifest is
    not written again. An empty batch commits the position of the one before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbers = _commits(spark, path)
        if number in numbers:
            return
        before = _commit(spark, path, max(k for k in numbers if k < number)) if any(k < number for k in numbers) else None
        folder = f"{path}/batch={number}"
        R.append_ledger(batch, order, before["last_seq"] if before else 0).write.mode("overwrite").parquet(folder)
        keys = F.to_json(F.max(F.struct(*order)))
        rows, last, position = spark.read.parquet(folder).agg(F.count("*"), F.max("seq"), keys).first()
        if not rows:
            last, position = (before["last_seq"], before["position"]) if before else (0, None)
        manifest = spark.createDataFrame([(number, last, rows, position)], COMMIT).coalesce(1)
        (commit or (lambda df, where: df.write.mode("overwrite").json(where)))(manifest, f"{path}/_commits/batch={number}")

    return write


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> None:
    """Works off what the source has now, by `write` for each batch or into parquet files at path."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(write).start() if write else w.format("parquet").option("path", path).start()
    q.awaitTermination()
