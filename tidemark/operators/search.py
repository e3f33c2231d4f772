"""Substring search over a table of bodies by posting lists of trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that the lists are dealt into by gram; a lookup reads those of its grams.
BUCKETS = 32
#: Rarest grams of a term whose lists are intersected before texts are read.
RAREST = 3
#: Characters of the texts whose lists are made at once, about, and codes that a table may hold.
CHARS, CODES = 1 << 21, 1 << 24


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """Written lists: `lists` (gram, ids), in any number of rows a gram, of trigrams and, as a side list
    for short terms, of single characters and pairs; `sizes` (gram, n): how many texts have it."""

    spark: SparkSession
    path: str
    kind: str

    def _table(self, name: str) -> DataFrame:
        column = f"ids array<{self.kind}>" if name == "lists" else "n long"
        return self.spark.read.schema(f"gram string, {column}, bucket int").parquet(f"{self.path}/{name}")

    def _of(self, table: str, wanted: list[str]) -> DataFrame:
        rows = self._table(table)
        found = sorted({r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "g string").select(bucket(F.col("g"))).collect()})
        return rows.where(F.col("bucket").isin(found) & F.col("gram").isin(wanted))

    def candidates(self, term: str) -> DataFrame:
        """id of the texts that have the rarest grams of a term, in lower case: all texts that
        contain it, and few others."""
        size = min(len(term), 3)
        own = sorted({term[k : k + size] for k in range(len(term) - size + 1)})
        # At most as many rows as the term has characters.
        n = {r["gram"]: r["n"] for r in self._of("sizes", own).collect()}
        if len(n) < len(own):
            return self._table("lists").select(F.explode("ids").alias("id")).limit(0)
        rarest = sorted(own, key=lambda g: (n[g], g))[:RAREST]
        return self._of("lists", rarest).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(rarest)).select("id")


def build(bodies: DataFrame, path: str) -> Index:
    """The index of bodies (id, body), written below path. A gram's list is a set of rows, so a
    frequent one is spread over files. Null bodies have no grams; ids are unique."""
    kind = bodies.schema["id"].dataType.simpleString()
    texts = bodies.select("id", F.lower(F.coalesce("body", F.lit(""))).alias("body"))
    rows = texts.mapInArrow(_lists, f"gram string, ids array<{kind}>").withColumn("bucket", bucket(F.col("gram")))
    rows.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/lists")
    index = Index(bodies.sparkSession, path, kind)
    index._table("lists").groupBy("bucket", "gram").agg(F.sum(F.size("ids")).cast("long").alias("n")).write.partitionBy("bucket").parquet(f"{path}/sizes")
    return index


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, ids: the runs of one to three characters of some texts at a time and the texts that have them."""
    for batch in batches:
        start = 0
        while start < len(batch):
            texts, chars = [], 0
            while start + len(texts) < len(batch) and (not texts or chars < CHARS):
                texts.append(batch["body"][start + len(texts)].as_py())
                chars += len(texts[-1])
            ids = batch["id"].slice(start, len(texts))
            start += len(texts)
            if chars:
                yield from _lists_of(texts, ids)


def _compact(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, all under `most`, and each code's place among them."""
    if most > CODES:
        return np.unique(codes, return_inverse=True)
    there = np.zeros(most, bool)
    there[codes] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int64) - 1)[codes]


def _lists_of(texts: list[str], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    signs, c = _compact(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), 0x110000)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    # The grams that are known so far, a row of code points each, and each place's gram.
    known, at = signs[:, None], c
    for size in (1, 2, 3):
        if size > 1:
            within = of[: len(c) - size + 1] == of[size - 1 :]
            # A place whose run would leave its text has no gram, nor has it a longer one.
            codes, places = _compact((at[: len(within)] * len(signs) + c[size - 1 :])[within], len(known) * len(signs))
            known = np.concatenate([known[codes // len(signs)], signs[codes % len(signs)][:, None]], axis=1)
            at = np.zeros(len(within), np.int64)
            at[within] = places
            owner = of[: len(within)][within]
        else:
            places, owner = at, of
        both = np.sort(places * len(texts) + owner)
        both = both[np.diff(both, prepend=-1) != 0]
        if not len(both):
            return
        gram, text = np.divmod(both, len(texts))
        begins = np.append(np.flatnonzero(np.diff(gram, prepend=-1)), len(gram)).astype(np.int32)
        line = known.astype("<u4").tobytes().decode("utf-32-le")
        names = pa.array([line[k : k + size] for k in range(0, len(line), size)])
        yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(begins, ids.take(pa.array(text)))], names=["gram", "ids"])


def containing(index: Index, bodies: DataFrame, term: str) -> DataFrame:
    """id of the bodies that contain a term, whatever the case: candidates only are read and looked
    through."""
    near = bodies.join(index.candidates(term.lower()), "id", "left_semi")
    return near.where(F.contains(F.lower("body"), F.lit(term.lower()))).select("id")


def public_match(items: DataFrame, direct: Column, index: Index, bodies: DataFrame, terms: list[str]) -> DataFrame:
    """The items (id and more) of which each term is in `direct`, in lower case, or in the body that
    the table of bodies has for them. Without terms all items match."""
    out = items
    for k, term in enumerate(terms):
        found = containing(index, bodies, term).withColumn(f"_in{k}", F.lit(True))
        out = out.join(found, "id", "left")
    has = [F.coalesce(F.contains(direct, F.lit(t.lower())), F.lit(False)) | F.col(f"_in{k}").isNotNull() for k, t in enumerate(terms)]
    return out.where(reduce(lambda a, b: a & b, has, F.lit(True))).drop(*[f"_in{k}" for k in range(len(terms))])


def share_read(index: Index, bodies: DataFrame, term: str) -> float:
    """The share of the bodies that a term's search reads."""
    total = bodies.count()
    return index.candidates(term.lower()).count() / total if total else 0.0
