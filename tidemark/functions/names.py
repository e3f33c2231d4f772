"""Titles and names that are the same, phrases to search by, and configurations of models."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import dice, let, title_bigrams

# Words that say nothing of a story's subject.
GENERIC = "心理健康|精神健康|心理学|心理|健康|科学|最新|新研究|研究|发现|新闻|论文|结果|表明|表示|相关|关于|我们|可以|一个|一种|这个|什么|如何|为什么|影响"


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, lower case, punctuation to single spaces."""

    def one(x):
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        return re.sub(r"[\W_]+", " ", plain.lower()).strip()

    return s.map(one)


def same_title(a: Column, b: Column) -> Column:
    """Equal when folded, or one begins the other and has four fifths of its length."""
    x, y = folded(a), folded(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (F.length(short) > 0) & ((x == y) | F.startswith(long, short) & (F.length(short) >= 0.8 * F.length(long)))


def han_fragments_in(phrase: Column, text: Column) -> Column:
    """Whether each run of two or more Han characters of the phrase is in the text; false without any."""
    runs = F.regexp_extract_all(phrase, F.lit(r"(\p{IsHan}{2,})"), F.lit(1))
    return (F.size(runs) > 0) & F.forall(runs, lambda r: F.contains(text, r))


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def two_fragments_in(phrase: Column, text: Column) -> Column:
    """Whether two different Han bigrams of the phrase, apart in it, are also apart in the text.

    Whole generic words are taken out of the phrase first, so they leave no fragment. Two bigrams
    are apart in the text if one, at its first place, ends before the other's last place.
    """
    runs = F.regexp_extract_all(F.regexp_replace(phrase, GENERIC, " "), F.lit(r"(\p{IsHan}{2,})"), F.lit(1))
    # run: which run of the phrase a bigram is in; place: where in it; first and last: in the text.
    last = lambda v: F.length(text) - F.position(F.reverse(v), F.reverse(text))
    seen = lambda r, k, i: let(F.substr(r, i, F.lit(2)), lambda v: F.struct(k.alias("run"), i.alias("place"), v.alias("value"), F.position(v, text).alias("first"), last(v).alias("last")))
    pairs = F.flatten(F.transform(runs, lambda r, k: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: seen(r, k, i))))
    split = lambda a, b: (a["run"] != b["run"]) | (F.abs(a["place"] - b["place"]) >= 2)
    meets = lambda a, b: (a["value"] != b["value"]) & split(a, b) & (a["first"] + 2 <= b["last"])
    return let(F.filter(pairs, lambda p: p["first"] > 0), lambda found: F.exists(found, lambda a: F.exists(found, lambda b: meets(a, b))))


def rule_match(posts: DataFrame, least: float = 0.3) -> DataFrame:
    """posts with matched: whether a post may be about a story. Its title is like one of the reports'
    by the Dice measure of bigrams, or two fragments of the story's phrase are in its text.

    posts: phrase, reports (array of titles), title, body. Nulls match nothing.
    """
    alike = F.exists("reports", lambda r: dice(title_bigrams(F.col("title")), title_bigrams(r)) >= least)
    # Columns of their own, since a lambda can't hold the Python function.
    rows = posts.withColumn("_phrase", compatible(F.col("phrase"))).withColumn("_text", compatible(F.concat_ws("\n", "title", "body")))
    found = F.coalesce(alike, F.lit(False)) | F.coalesce(two_fragments_in(F.col("_phrase"), F.col("_text")), F.lit(False))
    return rows.withColumn("matched", found).drop("_phrase", "_text")


def distinctive_phrase(text: Column, least: int = 6, most: int = 8, chars: int = 40) -> Column:
    """The first run of `least` to `most` words of a sentence with `chars` characters or more; null if none."""
    word = r"[A-Za-z][\w'’-]*"
    return F.nullif(F.get(F.filter(F.regexp_extract_all(text, F.lit(rf"({word}(?: {word}){{{least - 1},{most - 1}}})"), F.lit(1)), lambda p: F.length(p) >= chars), F.lit(0)), F.lit(""))


def unsupported_names(answer: Column, source: Column, lexicon: dict[str, str]) -> Column:
    """Names of the lexicon (name to pattern) that an answer has and its source has not."""
    found = lambda c: F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in lexicon.items()]))
    return F.array_except(found(answer), found(source))


def configuration(descriptor: Column) -> Column:
    """tier and effort of a run's descriptor: reasoning effort, else thinking, else plain."""
    low = F.lower(F.coalesce(descriptor, F.lit("")))
    effort = F.nullif(F.regexp_extract(low, r"\b(minimal|low|medium|high|xhigh|max)\b", 1), F.lit(""))
    off = low.rlike(r"\b(no|non|without)[ -]?(thinking|reasoning)\b")
    tier = F.when(off, "plain").when(effort.isNotNull(), "effort").when(low.rlike(r"\b(thinking|reasoning)\b"), "thinking").otherwise("plain")
    return F.struct(tier.alias("tier"), F.when(tier == "effort", effort).alias("effort"))
