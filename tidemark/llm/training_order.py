"""Training-order materialisation: every sequence gets a global slot, shards hold slots in order.

Texts become fixed-length token sequences in one pass. A sequence's number is its rank by document,
piece and content among all of them, counted in shares, so it depends on the rows alone and not on
files, splits or cluster. A keyed Feistel permutation with cycle-walking turns the number into a
slot. Range partitions then hold whole shards of fixed-stride records. Records travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import Scratch, met, need

#: Sequences that are ranked in one share, and shards that one task holds where there are many.
SHARE_ROWS, TASK_SHARDS = 20_000, 16
ROUNDS = 6


def sequences(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """doc_id, piece, n_tokens, ids_crc32, ids (two bytes an id, little-endian, compressed).

    A document is the ids of its text (null: empty) and end_id, cut every `length` ids.
    """
    if tokens.load(path).get_vocab_size() > 65_536:
        raise ValueError("two bytes hold no id of this vocabulary")
    end, encoding = end_id.to_bytes(4, "little"), tokens.Encoding(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.frombuffer(encoding.encode(text) + end, "<u4").astype("<u2")
                for k in range(0, len(ids), length):
                    own = ids[k : k + length].tobytes()
                    out.append((doc, k // length, len(own) // 2, tokens.crc32(own), press.compress(own)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "n_tokens", "ids_crc32", "ids"])

    slim = need(docs, "doc_id", "text").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    made = slim.mapInPandas(run, "doc_id string, piece int, n_tokens int, ids_crc32 long, ids binary")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def records(length: int, end_id: int):
    """Compressed ids to a record of length ids, filled up with end_id."""
    fill = end_id.to_bytes(2, "little")

    def opened(ids: pd.Series) -> pd.Series:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        return pd.Series([(raw := tool.decompress(x)) + fill * (length - len(raw) // 2) for x in ids], dtype=object)

    return F.pandas_udf(opened, "binary")


def mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A keyed 64-bit mix of each value: two multiply and shift steps."""
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slots of the indexes under the permutation of 0..n-1 that key names.

    An alternating Feistel network over pairs of Z_a x Z_b with a * b just over n. Values that
    land at n or above walk on along their cycle until they are below it, which always ends.
    """
    a = max(1, int(np.ceil(np.sqrt(n))))
    b = max(1, -(-n // a))
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}|{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // np.uint64(b), x % np.uint64(b)
        for r, k in enumerate(keys):
            if r % 2:
                right = (right + mix(left, k) % np.uint64(b)) % np.uint64(b)
            else:
                left = (left + mix(right, k) % np.uint64(a)) % np.uint64(a)
        return left * np.uint64(b) + right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (outside := out >= n).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def training_order(docs: DataFrame, path: str, key: str, length: int = 1024, end_id: int = 50256, shard_size: int = 4096) -> DataFrame:
    """slot, shard, byte_offset, doc_id, piece, n_tokens, record: one row a sequence, in shards.

    Slots are 0..n-1, each once. Shard s holds slots s * shard_size on; a record has 2 * length
    bytes, filled up with end_id, so slot k begins at byte_offset in its shard and a reader can go
    on from any slot. Each partition holds whole shards in slot order. Null text is a sequence of
    end_id alone; repeated rows each have their own sequences; no documents give no rows.
    The same rows get the same slots in whatever files and partitions they come.
    """
    spark = docs.sparkSession
    made = Scratch(spark).save(sequences(docs, path, length, end_id))
    n = made.count()
    order = ["doc_id", "piece", "ids_crc32"]
    shares = max(1, -(-n // SHARE_ROWS))
    dealt = made.withColumn("share_no", F.pmod(F.xxhash64(*order), F.lit(shares)).cast("int"))
    # One row for each SHARE_ROWS sequences, a few bytes each.
    sums = dealt.groupBy("share_no").agg(F.count("*").alias("rows"))
    starts = sums.select("share_no", F.coalesce(F.sum("rows").over(Window.orderBy("share_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("share_start"))
    ranked = dealt.withColumn("in_share", F.row_number().over(Window.partitionBy("share_no").orderBy(*order)) - 1)
    slot = F.pandas_udf(lambda i: pd.Series(permute(i.to_numpy(), n, key)), "long")
    placed = met(ranked, starts, ["share_no"], F.col("ids_crc32")).withColumn("slot", slot(F.col("share_start") + F.col("in_share")))
    placed = placed.select("slot", F.floor(F.col("slot") / shard_size).cast("long").alias("shard"), "doc_id", "piece", "n_tokens", "ids")
    shards = max(1, -(-n // shard_size))
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // TASK_SHARDS))
    return (
        placed.repartitionByRange(tasks, "shard")
        .sortWithinPartitions("slot")
        .select("slot", "shard", ((F.col("slot") % shard_size) * 2 * length).alias("byte_offset"), "doc_id", "piece", "n_tokens", records(length, end_id)("ids").alias("record"))
    )


def write_shards(ordered: DataFrame, uri: str) -> DataFrame:
    """Write each shard as a file shard-<number>.bin below uri; returns shard, n_records, n_bytes.

    uri: a store that executors share, by any scheme that pyarrow opens. A file is written under a
    name of its attempt and then moved, so a repeated or lost task leaves no half-written shard.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        attempt, open_no, out, n, size = TaskContext.get().taskAttemptId(), None, None, 0, 0

        def close():
            out.close()
            store.move(f"{root}/.{open_no}-{attempt}", f"{root}/shard-{open_no:08d}.bin")
            return pd.DataFrame([(open_no, n, size)], columns=["shard", "n_records", "n_bytes"])

        for b in batches:
            for shard, record in zip(b["shard"], b["record"], strict=True):
                if shard != open_no:
                    if out is not None:
                        yield close()
                    open_no, n, size = int(shard), 0, 0
                    out = store.open_output_stream(f"{root}/.{open_no}-{attempt}")
                out.write(record)
                n, size = n + 1, size + len(record)
        if out is not None:
            yield close()

    return ordered.select("shard", "record").mapInPandas(run, "shard long, n_records long, n_bytes long")
