import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text):
    return tokens.load(PATH).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoding(spark):
    return tokens.Encoding(spark, PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdl09ét 　|<>")), max_size=60))
def test_count_and_ids_are_the_librarys(encoding, text):
    ids = library(text)
    assert encoding.count(text) == len(ids)
    assert encoding.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("text", ["", " ", "\n\n\n", "a" * 3000, " " * 3000, "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "don't  we'll 'll"])
def test_odd_texts(encoding, text):
    assert encoding.count(text) == len(library(text))
    assert encoding.encode(text) == b"".join(i.to_bytes(4, "little") for i in library(text))


def test_whole_tokens_are_proved():
    whole = tokens.whole_tokens(PATH)
    assert len(whole) > 45_000
    for s in random.Random(1).sample(sorted(whole), 500):
        assert library(s) == [whole[s]]
    assert "<|endoftext|>" not in whole


def test_both_encoders_are_proved(spark, encoding):
    assert tokens.ranks_proved(PATH) and encoding.quick
    slow = tokens.Encoding(spark, PATH)
    slow.quick = False
    for text in ("Some plain words, and 12 more", "été <|endoftext|> x", "a" * 500):
        assert slow.encode(text) == encoding.encode(text)


def test_bound_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    own = tokens.Shortcut(PATH, tokens.whole_tokens(PATH), len)
    for k in range(40):
        text = f"zqxj{k} vwkq{k * 7}"
        assert sum(own.values(text)) == len(library(text))
    assert len(own.known) < len(own.whole) + 20


def test_query_rows(spark):
    docs = spark.createDataFrame([(1, "Hello world", 9), (None, None, 9), (1, "Hello world", 9), (2**60 + 1, "é" * 600, 9)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tokens.count_tokens(docs, PATH).collect()), key=str)
    want = [(i, len(t.encode()), len(library(t)), len(library(t)) > 512) for i, t in [(1, "Hello world"), (None, ""), (1, "Hello world"), (2**60 + 1, "é" * 600)]]
    assert got == sorted(want, key=str)
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_use_their_library(spark, name):
    path = public_tokenizers.path(name)
    text = "Hello wörld, tokens!"
    if name.endswith(".model"):
        import sentencepiece

        n = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    else:
        n = len(tokens.load(path).encode(text, add_special_tokens=False).ids)
    assert tokens.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first()["n_tokens"] == n
