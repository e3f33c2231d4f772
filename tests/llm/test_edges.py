"""Odd tables through every operator and stage: nulls anywhere, repeats, ties, no rows, clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, decontaminate, langid, licenses, neardup, packing, pii, quality, secret_scan, tokens, training_order

BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "w h lines gone _gone _id _host _rejected salt share root vertex v tree deal path item items item_id k all _hit _pii pii_values count n part_no row_no slot shard length piece n_tokens held_out near above dir threshold kept n_shingles component_id".split()
WORDS = " ".join(f"word{k % 977}" for k in range(12_000))
ROWS = [(1, "one two three four five six seven eight nine ten eleven", "en", "a"), (1, "one two three four five six seven eight nine ten eleven", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t\n", None, "b"), (5, WORDS, "fr", None), (6, "x" * 300_000, "fr", "b"), (None, "a text without an id has words enough to be one of ten or more", "en", None), (None, None, None, None), (7, "null \u0000 byte, 😀 and 4336980084469204 in a line of some more words here", "de", "b")]
OPERATORS = {
    "judge": lambda d: quality.judge(d)[0],
    "clean": quality.clean,
    "near_duplicates": neardup.near_duplicates,
    "keep_one": neardup.keep_one,
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id").cast("string").isin("5", "k5"), F.col("text")).alias("text"))),
    "pseudonymise": lambda d: pii.pseudonymise(d, "k"),
    "pack": lambda d: packing.pack(d, BPE),
    "count_tokens": lambda d: tokens.count_tokens(d, BPE),
    "training_order": lambda d: training_order.training_order(d, BPE, "k"),
    "identify": langid.identify,
    "scan": lambda d: licenses.scan(d.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))),
    "secret_report": secret_scan.report,
    "format_windows": lambda d: chat.format_windows(d.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("source").alias("role"), "text"), BPE),
}
#: How many rows come out: as many as went in, unless stated.
WANT = {"judge": 10, "keep_one": 10, "near_duplicates": 10, "pseudonymise": 10, "count_tokens": 10, "identify": 10, "scan": 10, "secret_report": 10, "decontaminate": 9}


def odd(spark, rows, clash):
    docs = spark.createDataFrame([(d, t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t, lang, s, None) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(c).alias(c) for c in CLASH]) if clash else docs


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](odd(spark, ROWS, True))
    assert out.count() == WANT.get(name, out.count()) and out.count() > 0


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](odd(spark, [], False)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_letters(spark, name):
    """The same rows with ids that are no numbers come out the same, under these ids."""
    docs = odd(spark, ROWS, False)
    named = docs.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    out, want = OPERATORS[name](named), OPERATORS[name](docs)
    assert out.count() == want.count()
    key = "conv_id" if "conv_id" in out.columns else "doc_id"
    ids = lambda rows, cut: sorted(str(r[key]).removeprefix(cut) for r in rows.select(key).collect())
    assert ids(out, "k") == ids(want, "")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd(spark, ROWS, True)
    out = stage(spark, docs, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns
        assert all(set(r) == {c} for c, r in zip(CLASH, zip(*out.select(*CLASH).collect())))
    assert stage(spark, odd(spark, [], True), str(tmp_path)).count() == 0
