"""What the training-data operators share: words, scratch tables and column guards."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
#: Tables of up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Shares that rows of a key that may be hot are dealt into where they are joined by shuffle.
SALTS = 16


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body reads it once an element."""
    # One parameter, whatever defaults body has: a second one would be given the index.
    return F.transform(F.array(value), lambda x: body(x))[0]


def shingle_hashes(word_array: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of `width` words, in order; none if there are fewer words."""

    def of(w: Column) -> Column:
        last = F.size(w) - width
        run = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(last >= 0, run).otherwise(F.array().cast("array<bigint>"))

    return let(word_array, of)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further ones of any name do no harm."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def width(field: T.StructField) -> Column:
    """About how many bytes a column's value takes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c) + 16
    elif isinstance(field.dataType, T.ArrayType):
        inner = isinstance(field.dataType.elementType, (T.StringType, T.BinaryType))
        size = F.aggregate(c, F.lit(0), lambda n, x: n + F.octet_length(x) + 16) if inner else 16 * F.size(c) + 16
    else:
        size = F.lit(16)
    return F.coalesce(size, F.lit(16)).cast("long")


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all of df takes at most limit bytes; measured, with one pass over df."""
    size = reduce(lambda x, y: x + y, [width(f) for f in df.schema.fields])
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if it takes few bytes; a shuffle join takes it otherwise."""
    return F.broadcast(df) if fits(df, limit) else df


def met(rows: DataFrame, side: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """rows joined with side on the columns on, which may be hot in rows.

    side is broadcast if it fits. Otherwise rows of a key are dealt into SALTS shares by the hash
    of spread, and each row of side goes to all of them.
    """
    if fits(side):
        return rows.join(F.broadcast(side), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`, or the
    one set on its context. On one machine alone, where neither is set, a new temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


class Scratch:
    """Tables written to the folder that all executors share, which cut the lineage.

    They hold until they are dropped or the driver's Python ends, since results read them late.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        self.tables: dict[int, str] = {}
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.tables) + 1}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[len(self.tables) + 1] = path
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove saved tables that nothing will read again."""
        for df in tables:
            self._delete(df.scratch_path)

    def close(self) -> None:
        # Once the session has ended there is nobody left to ask; its own folder then goes with it.
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
