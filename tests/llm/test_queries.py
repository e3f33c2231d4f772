"""The registered queries: against their SQL where they have any, else by what must hold of their rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import compare
from tidemark.llm import queries
from tidemark.session import table

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
FOUND = queries.REGISTRY


@pytest.mark.parametrize("name", FOUND.sql)
def test_against_sql(spark, name):
    compare(spark, FOUND.queries[name], FOUND.sql[name], SF)


def test_one_row_a_document(spark):
    n = table(spark, SF, "documents").count()
    for name in ("op1_pii_pseudonyms", "op8_license_scan", "op9_token_counts", "op10_nearest_centroid"):
        out = FOUND.queries[name](spark, SF)
        assert (name, out.count(), out.select("doc_id").distinct().count()) == (name, n, n)


def test_training_order_slots(spark):
    out = FOUND.queries["op3_training_order"](spark, SF).select("slot", "doc_id", "piece", F.length("record").alias("n")).toPandas()
    assert sorted(out["slot"]) == list(range(len(out)))
    assert set(out["n"]) == {2048}


def test_packing_is_gapless(spark):
    out = FOUND.queries["op7_bin_completion"](spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    at, seq = 0, None
    for r in out.itertuples():
        at = at if r.sequence_id == seq else 0
        assert r.offset == at
        at, seq = at + r.length, r.sequence_id
        assert at <= 1024


def test_languages_are_told_apart(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang").where("lang is not null")
    out = FOUND.queries["op10_nearest_centroid"](spark, SF).join(docs, "doc_id").where("held_out and lang_pred <> 'und'")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_chat_query_has_the_marked_conversation(spark):
    out = FOUND.queries["op4_chat_windows"](spark, SF)
    assert out.count() == table(spark, SF, "conversations").select("conv_id").distinct().count() + 1
    row = out.where("conv_id = -7").first()
    assert (row["n_turns"], row["loss_chars"]) == (2, len("</s>[INST] ok [/INST]"))


def test_pipeline_rows(spark, tmp_path):
    """Stages written and read again give the same rows as the chain; all but the last keep columns."""
    docs = table(spark, SF, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == table(spark, SF, "documents").columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert 0 < docs.select("doc_id").distinct().count() < table(spark, SF, "documents").count()
    keys = ["doc_id", "piece", "ids_crc32"]
    assert sorted(docs.select(keys).collect()) == sorted(corpus_pipeline.run(spark, SF).select(keys).collect())
