"""Exact nearest neighbours by pruned lists: most pairs are refuted by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed

#: Rows that stand for a cluster each, and queries that are compared in one pass over the rows.
CENTRES, BLOCK = 64, 4096
#: Cosines are compared to nine digits; squared distances closer than that are not told apart.
DIGITS, SLACK = 9, 4e-9


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, float) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def lists(rows: DataFrame, centres: int = CENTRES) -> tuple[DataFrame, np.ndarray]:
    """rows (id, v) as id, v, cluster, far (the distance to its centre), in lists by cluster, and the
    centres: `centres` of the rows themselves, those of the least hashed vectors. Vectors that are
    null, empty or without a direction are left out."""
    usable = rows.where(F.size("v") > 0).where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).select("id", F.col("v").cast("array<double>").alias("v"))
    chosen = usable.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(centres).toPandas()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, cluster int, far double"
    if chosen.empty:
        return usable.sparkSession.createDataFrame([], schema), np.zeros((0, 1))
    heads = _unit(chosen["v"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = _unit(b["v"])
                far = _distance(v, heads)
                at = far.argmin(1)
                yield pd.DataFrame({"id": b["id"], "v": list(v), "cluster": at.astype("int32"), "far": far[np.arange(len(v)), at]})

    # A list is sorted by distance, so that a batch of it lies in a narrow ring; a large one is dealt over tasks.
    dealt = usable.mapInPandas(assign, schema).repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(16)))
    return checkpointed(dealt.sortWithinPartitions("cluster", "far")), heads


def nearest(queries: DataFrame, rows: DataFrame, centres: int = CENTRES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """query, nearest, cosine (to nine digits; the smaller id of equal ones), and scored, of: how
    many pairs were scored, of how many that there are. queries: query (an id), v. rows: id, v.

    A row is no neighbour of the query of its own id. In a pass each task meets a block of queries
    with the rows of its lists: a list is skipped for the queries whose best so far is nearer than
    the list's ring can be, a row for those that its distance to the centre refutes. A first best
    comes from the centres' rows. Queries come to the driver a block at a time.
    """
    spark = rows.sparkSession
    held, heads = lists(rows, centres)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query {kind}, nearest {kind}, cosine double, scored long"
    asked = checkpointed(queries.where(F.size("v") > 0).where(F.exists("v", lambda x: x != 0)).select("query", F.col("v").cast("array<double>").alias("v")))
    blocks = ceil(asked.count() / block)
    total = held.count()
    found = []
    for k in range(blocks if len(heads) else 0):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).orderBy("query").toPandas()
        if part.empty:
            continue
        q, names = _unit(part["v"]), part["query"].to_numpy()
        to_heads = _distance(q, heads)

        def meet(batches: Iterator[pd.DataFrame], q: np.ndarray = q, names: np.ndarray = names, to_heads: np.ndarray = to_heads) -> Iterator[pd.DataFrame]:
            best, other = np.full(len(q), -np.inf), np.full(len(q), None, object)
            scored = np.zeros(len(q), np.int64)
            # Two centres at least are other rows; the second nearest bounds the best from above.
            limit = np.partition(to_heads, 1, axis=1)[:, 1] if to_heads.shape[1] > 1 else np.full(len(q), 2.0)
            limit = limit**2 + SLACK
            for b in batches:
                for cluster, g in b.groupby("cluster", sort=False):
                    far, way = g["far"].to_numpy(), to_heads[:, cluster]
                    least = np.maximum(0, np.maximum(way - far.max(), far.min() - way))
                    near = np.flatnonzero(least**2 <= limit)
                    if not len(near):
                        continue
                    v, ids = np.stack(g["v"].to_numpy()), g["id"].to_numpy()
                    open_ = (way[near][:, None] - far[None]) ** 2 <= limit[near][:, None]
                    open_ &= names[near][:, None] != ids[None]
                    for j, i in enumerate(near):
                        at = np.flatnonzero(open_[j])
                        if len(at):
                            s = np.round(v[at] @ q[i], DIGITS)
                            scored[i] += len(at)
                            top = s.max()
                            first = min(ids[at[s == top]])
                            if top > best[i] or top == best[i] and first < other[i]:
                                best[i], other[i] = top, first
                                limit[i] = min(limit[i], max(0.0, 2 - 2 * top) + SLACK)
            seen = np.flatnonzero(scored)
            yield pd.DataFrame({"query": names[seen], "nearest": list(other[seen]), "cosine": best[seen], "scored": scored[seen]})

        found.append(held.mapInPandas(meet, schema))
    if not found:
        none = spark.createDataFrame([], schema)
        return none.drop("scored"), none.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")).withColumn("of", F.lit(0).cast("long"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = checkpointed(every)
    best = every.groupBy("query").agg(F.max("cosine").alias("cosine"))
    out = every.join(best, ["query", "cosine"]).groupBy("query", "cosine").agg(F.min("nearest").alias("nearest")).select("query", "nearest", "cosine")
    return out, every.agg(F.sum("scored").alias("scored")).withColumn("of", F.lit(total * asked.count()))
