"""Session settings and table access."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def build(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine assumes; on a cluster, submit with the same ones."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`, or the
    one set on its context. On one machine alone, where neither is set, a new temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and cut off from its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def width(field: T.StructField) -> Column:
    """About how many bytes a column's value takes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c) + 16
    elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        size = F.octet_length(F.to_json(F.struct(c))) + 16
    else:
        size = F.lit(16)
    return F.coalesce(size, F.lit(16)).cast("long")


def few(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if it takes few bytes, which one pass measures; else as it is."""
    size = reduce(lambda x, y: x + y, [width(f) for f in df.schema.fields])
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df
