"""Whole-token shortcut: token ids and counts without merging most pre-tokens.

A byte-level vocabulary holds many strings that, standing alone as a pre-token, encode as
exactly one token. `whole_tokens` proves that on the driver, once, for every vocabulary string by
encoding it; the table goes to the tasks. They split texts into pre-tokens, look the proved ones
up, and run the merges of the library's model for the rest only; merged pre-tokens are remembered
up to a bound.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import need

#: Merged pre-tokens that one Python worker remembers; beyond it, it forgets all and starts anew.
REMEMBERED = 300_000
LONG, LONG_RUN = 10_000, re.compile(r"\s{10000}|\S{10000}")
assert sys.byteorder == "little"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes get the characters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def splitter():
    """The pre-token pattern of the byte-level vocabularies."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> dict[str, int]:
    """The strings that are one pre-token and encode alone as one token, with its id."""
    tok, split = load(path), splitter()
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    ids = range(tok.get_vocab_size())
    texts = [tok.decode([i], skip_special_tokens=False) for i in ids]
    found = tok.encode_batch(texts, add_special_tokens=False)
    return {s: i for i, s, e in zip(ids, texts, found, strict=True) if e.ids == [i] and s not in special and split.findall(s) == [s]}


class Shortcut:
    """Pre-tokens to values, for one worker: value(ids) is what a pre-token stands for."""

    def __init__(self, path: str, whole: dict[str, int], value):
        import regex

        tok = load(path)
        self.value, self.model = value, tok.model
        self.alphabet = byte_alphabet()
        self.whole = {s: value([i]) for s, i in whole.items()}
        self.known = dict(self.whole)
        added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.added = {s: value([i]) for s, i in added.items()}
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.find = splitter().findall

    def merge(self, piece: str):
        text = piece.encode().decode("latin-1").translate(self.alphabet)
        return self.value([t.id for t in self.model.tokenize(text)])

    def values(self, text: str) -> list:
        """The values of a text's pre-tokens in order; added strings inside it are one token each."""
        if self.marks is not None and self.marks.search(text):
            out = []
            for k, part in enumerate(self.marks.split(text)):
                out += [self.added[part]] if k % 2 else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list:
        pieces, known = self.find(text), self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > len(self.whole) + REMEMBERED:
                known = self.known = dict(self.whole)
            for p in set(pieces):
                if p not in known:
                    known[p] = self.merge(p)
            return [known[p] for p in pieces]


#: One worker's shortcuts by vocabulary and what they give.
MADE: dict[tuple[str, str], Shortcut] = {}


def packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(maxsize=4)
def ranked(path: str):
    """An encoder by ranks with the same vocabulary, which makes no objects of single tokens.

    None unless ids rise in the order of the merges, and unless it gives every vocabulary string
    the ids that the library of the file gives it.
    """
    import json

    import public_tokenizers
    import tiktoken

    if not is_byte_level(path):
        return None
    with open(path) as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    byte_of = {c: b for b, c in byte_alphabet().items()}
    added = {t.content: i for i, t in load(path).get_added_tokens_decoder().items()}
    ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in vocab.items() if s not in added}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=4)
def ranks_proved(path: str) -> bool:
    """Whether the encoder by ranks gives every vocabulary string the library's ids."""
    quick, tok = ranked(path), load(path)
    if quick is None:
        return False
    texts = [tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())]
    return all(e.ids == quick.encode(t, allowed_special="all") for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True))


class Encoding:
    """What tasks need to encode with a vocabulary, proved on the driver and shipped once.

    encode gives a text's ids, four little-endian bytes each, count their number; added strings
    inside a text are one token. Vocabularies that are not byte-level go to their library.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.quick = path, is_byte_level(path) and ranks_proved(path)
        self.whole = spark.sparkContext.broadcast(whole_tokens(path)) if is_byte_level(path) else None

    def _shortcut(self, name: str, value) -> Shortcut:
        if (self.path, name) not in MADE:
            MADE[self.path, name] = Shortcut(self.path, self.whole.value, value)
        return MADE[self.path, name]

    def count(self, text: str) -> int:
        return _library_count(self.path)(text) if self.whole is None else sum(self._shortcut("count", len).values(text))

    def encode(self, text: str) -> bytes:
        # The splitter of the encoder by ranks may give up on very long runs of one kind.
        if self.quick and not (len(text) > LONG and LONG_RUN.search(text)):
            return array("I", ranked(self.path).encode(text, allowed_special="all")).tobytes()
        return b"".join(self._shortcut("encode", packed).values(text))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


@lru_cache(maxsize=4)
def _library_count(path: str):
    """Counts by the library itself, for the kinds of vocabulary without the shortcut."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    tok = load(path)
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


def is_byte_level(path: str) -> bool:
    import json

    if not path.endswith(".json"):
        return False
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, over the whole text.

    path: a vocabulary file that every executor has. Byte-level vocabularies take the shortcut,
    others the library's own encoder. A null text counts as empty: 0 bytes, 0 tokens. Null and
    repeated ids keep their rows; no row moves between partitions.
    """
    encoding = Encoding(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in b["text"]], "n_tokens": [encoding.count(t) for t in b["text"]]})

    slim = need(docs, "doc_id", "text").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    counted = slim.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
