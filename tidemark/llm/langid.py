"""Language identification by nearest centroid with distance-based rejection.

Texts become normalised TF-IDF vectors of hashed byte n-grams. Each language's sampled vectors
are clustered, so a language has several centroids; a text takes the language of the centroid of
the largest cosine, and is marked rejected where even that one is too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, need

BUCKETS = 1 << 13
#: Labelled texts a language that the classifier is fitted on at most: those of the least hashed
#: ids, each text of an id once. Everything else reads all rows and whole texts.
SAMPLE = 250
CENTROIDS, ROUNDS = 3, 12
#: A text is rejected below this part of the cosine that 99 in 100 of a centroid's own texts reach.
REJECT = 0.6
LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter counts as a space.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams of two and three bytes occur in the whole text."""
    b = FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(65_599) + b[2:]
    out = np.zeros(BUCKETS, np.float32)
    for grams in (two, three):
        out += np.bincount((grams * np.uint32(2_654_435_761)) >> np.uint32(19), minlength=BUCKETS).astype(np.float32)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        return unit(np.log1p(np.stack([counts(t) for t in texts])) * self.idf)


def clustered(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of rows by spherical k-means from farthest-first seeds, and each row's cosine."""
    seeds = [unit(rows.mean(0, keepdims=True))[0]]
    while len(seeds) < min(k, len(rows)):
        seeds.append(rows[np.argmin(np.max(rows @ np.stack(seeds).T, axis=1))])
    centres = np.stack(seeds)
    for _ in range(ROUNDS):
        nearest = np.argmax(rows @ centres.T, axis=1)
        # An outlier alone is no centre: clusters of under a twentieth of the rows are dropped.
        sums = [rows[nearest == c].sum(0) for c in range(len(centres)) if (nearest == c).sum() * 20 >= len(rows)]
        centres = unit(np.stack(sums))
    return centres, rows @ centres.T


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """doc_id, lang, text of the labelled rows that are learned from: at most per_language for
    each value of lang, whatever repeats, those of the least hashed ids."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).withColumn("h", F.xxhash64("text"))
    # Rows that are equal in all of these have one rank, and are one once they are distinct.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    chosen = labelled.select("doc_id", "lang", "h").withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= per_language).select("doc_id", "lang", "h").distinct()
    return labelled.join(F.broadcast(chosen), ["doc_id", "lang", "h"]).dropDuplicates(["doc_id", "lang", "h"]).select("doc_id", "lang", "text")


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model | None:
    """The model of the labelled rows with an id that are not held out; None if there are none.

    N-grams are kept as sparse rows. One task clusters the rows of one value of lang, at most
    per_language; the driver gets a number for each bucket and CENTROIDS rows of them a language.
    """
    scratch = Scratch(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counts(t) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "key": b["key"], "at": [np.flatnonzero(c).astype(np.int32) for c in found], "n": [c[c > 0] for c in found]})

    keyed = sample(docs, per_language).select("lang", "text", F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64("text")).alias("key"))
    rows = scratch.save(keyed.mapInPandas(run, "lang string, key string, at array<int>, n array<float>").where(F.size("at") > 0))
    total = rows.count()
    if not total:
        return None
    have = np.zeros(BUCKETS)
    for at, n in rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        have[at] = n
    idf = (np.log((1 + total) / (1 + have)) + 1).astype(np.float32)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key")
        tf = np.zeros((len(g), BUCKETS), np.float32)
        for k, (at, n) in enumerate(zip(g["at"], g["n"], strict=True)):
            tf[k, at] = n
        c, near = clustered(unit(np.log1p(tf) * idf), CENTROIDS)
        return pd.DataFrame({"lang": g["lang"].iloc[0], "nth": range(len(c)), "centre": list(c.astype(np.float32)), "least": REJECT * float(np.quantile(near.max(1), 0.01))})

    found = rows.groupBy("lang").applyInPandas(one, "lang string, nth int, centre array<float>, least double").toPandas().sort_values(["lang", "nth"])
    scratch.close()
    return Model(idf, np.stack(found["centre"]).astype(np.float32), found["lang"].tolist(), found["least"].to_numpy(np.float32))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs.

    Rows with crc32(doc_id as text) % 4 = 2 are held out of learning. A null text or one without
    a letter is `und` with score 0. With no labelled row, all are. score: the cosine, 0 to 1.
    rejected: the text is farther from every language than that language's own texts are.
    """
    own = need(docs, "doc_id", "text", "lang")
    model = fit(own, per_language)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            out = [("und", 0.0, False)] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if model else []
            for k in range(0, len(known), 256):
                part = known[k : k + 256]
                near = model.vectors([texts[i] for i in part]) @ model.centroids.T
                for i, c, score in zip(part, near.argmax(1), near.max(1), strict=True):
                    out[i] = (model.languages[c], float(min(1.0, max(0.0, score))), bool(score < model.limits[c]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "rejected": [x[2] for x in out]})

    slim = own.select(F.col("doc_id").cast("string"), held_out().alias("held_out"), "text")
    return slim.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double, rejected boolean").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
