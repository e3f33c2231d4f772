"""Documents to packed training sequences, in five stages.

Each stage takes all rows that the one before kept and gives them with the columns of documents,
whatever else these are named; only the last gives packed pieces. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, neardup, packing, pii, quality
from tidemark.llm.queries import BYTE_BPE, PII_KEY
from tidemark.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects short, repetitive and depleted documents, and takes common lines out of the rest. Null and
    empty texts are short, so they go; a repeated row is judged like any other. Texts are read whole."""
    return quality.clean(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one of the smallest id, ties by text; documents
    without words have no duplicates and stay. Very long texts are compared by all their shingles."""
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that hold four fifths or more of the shingles of a benchmark item, in texts of any
    length. Null texts and ids hold nothing and stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in each text by itself. Null texts stay null, equal texts come out equal."""
    return pii.pseudonymise(docs, PII_KEY, count_as=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into pieces and packs these into sequences. A null text is an empty one, repeated rows
    are packed as often as they come, and a very long text gives as many pieces as it needs."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("quality_rules", quality_rules), ("near_dedup", one_of_each), ("decontaminate", without_benchmark), ("pii", pseudonyms), ("packing", pack)]
#: The stages' hashes, sketches, keyed permutations and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
