"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Documents and items are partitioned by size, a class k holding up to 2^k shingles. For a pair of
classes, hashes are dealt by their top bits into 2^bits bins, and a set's sketch is the least hash
in each bin: one-permutation MinHash. A short item inside a set of u shingles has a Jaccard
similarity of only about 1 / u, so bits follow from both classes: as few as miss an item of the
least size in its class, contained just to the threshold, with probability MISS. Least hashes of
wide bins are least in narrow bins too, so a document gives its finest sketch once, each hash
with its predecessor, and whether it is least for an item's class too shows when they meet.
Candidates are verified by exact shingle containment. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, let, met, need, shingle_hashes, small, words

THRESHOLD = 0.8
#: Probability to miss an item that is contained just to the threshold.
MISS = 1e-4
LARGEST_CLASS = 30


def shingles(text: Column) -> Column:
    """All five-word shingles of the text in lower case, as hashes, in order."""
    return shingle_hashes(words(F.lower(text)))


def size_class(n: Column) -> Column:
    """k for 2^(k-1)+1 to 2^k shingles."""
    return F.least(F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))), F.lit(LARGEST_CLASS)).cast("int")


def bits_for(k: int, shortest: int, threshold: float = THRESHOLD) -> int:
    """The bits of the bins in which sets of class k meet items of shortest shingles and more.

    With x hashes in a bin on average, a hash is the least of its bin with probability
    (1 - exp(-x)) / x; an item has threshold * shortest chances at least.
    """
    chances = max(1.0, threshold * shortest)
    for bits in range(1, 63):
        x = 2.0 ** (k - bits)
        if (1 - -math.expm1(-x) / x) ** chances <= MISS:
            return bits
    return 63


def least_of_bins(hashes: Column, bits: Column) -> Column:
    """h and before, the hash below it or null, for the least hash of each bin. Bins are ranges of
    the top bits, so that in sorted hashes the first one of a bin is its least."""
    pairs = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), F.get(h, i - 1).alias("before")))
    return let(F.sort_array(hashes), lambda h: F.filter(pairs(h), lambda p: is_least(p["h"], p["before"], bits)))


def is_least(h: Column, before: Column, bits: Column) -> Column:
    """Whether h is the least of its bin of the top bits, before being the next hash below it."""
    return before.isNull() | (_right(h, 64 - bits) != _right(before, 64 - bits))


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: the items whose distinct shingles a
    document holds to the threshold at least, one row a pair.

    docs: doc_id, text; items: item_id, text. Null texts and texts of fewer than five words have
    no shingles and match nothing. Rows that repeat an id add their pairs once, with the most
    shared. Runs jobs on items and candidates when called.
    """
    scratch = Scratch(docs.sparkSession)
    wanted = need(items, "item_id", "text").select("item_id", F.array_distinct(shingles(F.col("text"))).alias("item")).where(F.size("item") > 0)
    wanted = scratch.save(wanted.withColumn("n_item", F.size("item")).withColumn("j", size_class(F.col("n_item"))))
    own = need(docs, "doc_id", "text")
    # One row for each class of items, at most LARGEST_CLASS + 1.
    shortest = {r["j"]: r["n"] for r in wanted.groupBy("j").agg(F.min("n_item").alias("n")).collect()}
    if not shortest:
        return own.select("doc_id").crossJoin(wanted.select("item_id")).where(F.lit(False)).select("doc_id", "item_id", *[F.lit(None).cast(t).alias(c) for c, t in (("n_item", "int"), ("n_shared", "int"), ("containment", "double"))])
    bits = {(j, k): bits_for(k, n, threshold) for j, n in shortest.items() for k in range(LARGEST_CLASS + 1)}
    finest = F.create_map(*[F.lit(x) for k in range(LARGEST_CLASS + 1) for x in (k, max(b for (_, at), b in bits.items() if at == k))])
    of_pair = F.create_map(*[F.lit(x) for (j, k), b in bits.items() for x in (j * 100 + k, b)])
    least_class = size_class(F.ceil(threshold * F.col("n_item")))
    partitions = wanted.select("item_id", "item", "j", F.explode(F.sequence(least_class, F.lit(LARGEST_CLASS))).alias("k")).withColumn("bits", of_pair[F.col("j") * 100 + F.col("k")])
    index = partitions.select("item_id", "k", "bits", F.explode(least_of_bins(F.col("item"), F.col("bits"))).alias("m"))
    index = scratch.save(index.select("item_id", "k", "bits", "m.h"))
    hashed = own.select("doc_id", shingles(F.col("text")).alias("all")).where(F.size("all") > 0).withColumn("k", size_class(F.size("all")))
    sketched = hashed.select("doc_id", "k", F.explode(least_of_bins(F.col("all"), finest[F.col("k")])).alias("m")).select("doc_id", "k", "m.h", "m.before")
    # A shingle that very many documents share is dealt into shares of documents.
    pairs = met(sketched, index, ["k", "h"], F.col("doc_id")).where(is_least(F.col("h"), F.col("before"), F.col("bits")))
    pairs = scratch.save(pairs.select("doc_id", "item_id").distinct())
    by_doc = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items")).withColumnRenamed("doc_id", "_id")
    found = own.join(small(by_doc), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", F.array_distinct(shingles(F.col("text"))).alias("all"), F.explode("items").alias("item_id"))
    shared = met(found, wanted.drop("j"), ["item_id"], F.col("doc_id")).select("doc_id", "item_id", "n_item", F.size(F.array_intersect("all", "item")).alias("n_shared"))
    verified = shared.where(F.col("n_shared") >= threshold * F.col("n_item")).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return verified.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold an item; all others as they are.

    A text decides its own fate, so rows are told apart by its digest and not by ids, which may
    be null or repeated.
    """
    own = F.md5(F.col("`text`").cast("binary"))
    hit = contained(docs.select(own.alias("doc_id"), F.col("`text`").alias("text")), items, threshold)
    hit = Scratch(docs.sparkSession).save(hit.select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(small(hit), F.md5(docs["`text`"].cast("binary")) == hit["_hit"], "left_anti")
