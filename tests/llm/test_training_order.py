import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import tokens
from tidemark.llm.training_order import permute, training_order, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_bytes(text):
    return b"".join(i.to_bytes(4, "little") for i in tokens.load(PATH).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    slots = permute(np.arange(n), n, "k")
    assert sorted(slots) == list(range(n))
    assert (slots == permute(np.arange(n), n, "k")).all()
    if n > 60:
        assert (slots != permute(np.arange(n), n, "other")).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.3


def test_order_and_shards(spark, tmp_path):
    docs = [(k, f"document {k} " + "words and more words " * (k % 9)) for k in range(60)] + [(None, None), (5, "document 5 again"), (70, "x y " * 500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "3 as slot", "'a' as record").repartition(5)
    ordered = training_order(frame, PATH, "key", length=16, shard_size=8)
    rows = sorted(ordered.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    want = sorted((doc or -1, k // 16, ids[k : k + 16].tobytes()) for doc, text in docs for ids in [np.append(np.frombuffer(ids_bytes(text), "<u4"), 50256).astype("<u2")] for k in range(0, len(ids), 16))
    assert sorted((r["doc_id"] or -1, r["piece"], bytes(r["record"])[: 2 * r["n_tokens"]]) for r in rows) == want
    assert all(len(r["record"]) == 32 and bytes(r["record"])[2 * r["n_tokens"] :] == (50256).to_bytes(2, "little") * (16 - r["n_tokens"]) for r in rows)
    assert all(r["shard"] == r["slot"] // 8 and r["byte_offset"] == r["slot"] % 8 * 32 for r in rows)
    written = {r["shard"]: r["n_records"] for r in write_shards(ordered, f"file://{tmp_path}/shards").collect()}
    assert sum(written.values()) == len(rows)
    for shard in written:
        data = (tmp_path / "shards" / f"shard-{shard:08d}.bin").read_bytes()
        assert data == b"".join(bytes(r["record"]) for r in rows if r["shard"] == shard)
    # Resume: the record of any slot is at its stride.
    slot = rows[11]
    assert (tmp_path / "shards" / "shard-00000001.bin").read_bytes()[slot["byte_offset"] :][:32] == bytes(slot["record"])


def test_slots_do_not_depend_on_partitions(spark, monkeypatch):
    import tidemark.llm.training_order as module

    monkeypatch.setattr(module, "SHARE_ROWS", 20)
    docs = [(f"d{k % 50}", f"document {k % 90} " + "words and more words " * (k % 9)) for k in range(100)] + [(None, None), (None, "x")]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    found = [sorted((r["slot"], r["doc_id"] or "", r["piece"], bytes(r["record"])) for r in training_order(frame.repartition(n), PATH, "key", length=16, shard_size=8).collect()) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and [r[0] for r in found[0]] == list(range(len(found[0])))


def test_no_documents(spark):
    assert training_order(spark.createDataFrame([], "doc_id long, text string"), PATH, "k").count() == 0
