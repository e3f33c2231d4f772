"""Quality rules: text statistics, and line frequency across the documents of a host.

DataFrame functions only. Lines are hashed after normalising; a line that too many documents of
a host share is boilerplate and goes from all of them but the first; documents that are left
with too little are rejected. Texts take part in no shuffle that decides, only their hashes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SHINGLE, WORD, Scratch, let, need, shingle_hashes, words

#: A line is boilerplate if more than MAX_DOCS documents of its host have it, or more than
#: MAX_SHARE of them and MIN_DOCS at least.
MAX_DOCS, MAX_SHARE, MIN_DOCS = 20, 0.1, 5
#: A line of fewer than LINE_WORDS words may well be a heading of many texts: it is boilerplate
#: only if more than SHORT_SHARE of the host's documents have it, and SHORT_DOCS at least.
LINE_WORDS, SHORT_SHARE, SHORT_DOCS = 5, 0.3, 10
#: A document is depleted if less than this part of its words is left.
MIN_LEFT = 0.5
#: Common lines are joined in so many shares. MIN_DOCS documents share each line that is copied
#: to all shares, so the copies are at most SALTS / MIN_DOCS times the lines.
SALTS = 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """The hash of a line in lower case with single spaces."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, r"\s+", " "))))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more in the array of all windows."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.coalesce(F.least(F.get(places, i + 1) - p, F.lit(SHINGLE)), F.lit(SHINGLE)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def marked(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        twice = F.filter(pairs, lambda p, i: same(i, i - 1) | same(i, i + 1))
        return let(F.array_sort(F.transform(twice, lambda p: p["i"])), covered)

    sorted_pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(sorted_pairs(h), marked)).otherwise(0))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines,
    an array of the hash and the number of words of each line with a word.

    A null text has no words and no lines.
    """
    text = F.coalesce("text", F.lit(""))
    with_words = need(docs, "doc_id", "source", "text").select("doc_id", "source", text.alias("text"), words(F.col("text")).alias("w"))
    worded = F.filter(lines_of(F.col("text")), lambda x: x.rlike(WORD))
    judged = let(worded, lambda ls: F.transform(ls, lambda x: F.struct(line_hash(x).alias("h"), word_count(x).alias("n"))))
    return with_words.select(
        "doc_id", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(worded, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated_words(shingle_hashes(F.col("w"))).cast("long").alias("n_repeat_words"),
        judged.alias("lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def documents() -> Column:
    """How many documents; those without an id are one."""
    return F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))


def common_lines(stats: DataFrame) -> DataFrame:
    """doc_id, source, gone: for each document that loses lines, their hashes.

    Distinct documents are counted per host and line, and per host. The first document (by id)
    with a line keeps it, so no content is lost from all. A null source is a host of its own.
    """
    lines = stats.select("doc_id", "source", F.explode(F.array_distinct("lines")).alias("line")).select("doc_id", "source", "line.h", "line.n")
    hosts = stats.groupBy("source").agg(documents().alias("host_docs")).select(F.col("source").alias("host"), "host_docs")
    counts = lines.groupBy("source", "h").agg(documents().alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("n").alias("n")).where(F.col("n_docs") >= MIN_DOCS)
    long = (F.col("n") >= LINE_WORDS) & ((F.col("n_docs") > MAX_DOCS) | (F.col("n_docs") > MAX_SHARE * F.col("host_docs")))
    short = (F.col("n") < LINE_WORDS) & (F.col("n_docs") >= SHORT_DOCS) & (F.col("n_docs") > SHORT_SHARE * F.col("host_docs"))
    over = counts.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(long | short)
    over = over.select(F.col("source").alias("host"), F.col("h").alias("line"), "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(over, (F.col("h") == F.col("line")) & (F.col("salt") == F.col("share")) & F.col("source").eqNullSafe(F.col("host")))
    return found.where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("doc_id", "source").agg(F.collect_set("h").alias("gone"))


def with_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    named = gone.select(F.col("doc_id").alias("_id"), F.col("source").alias("_host"), F.col("gone").alias("_gone"))
    return rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_host")), "left").drop("_id", "_host")


def judge(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdict on each row of docs, and the lines that documents lose.

    The verdict: doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_words, kept. A document is kept unless base_failed or depleted. Repeated
    rows get a verdict each and count as one document.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.save(statistics(docs))
    gone = scratch.save(common_lines(stats))
    lost = F.aggregate(F.filter("lines", lambda x: F.array_contains("_gone", x["h"])), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    out = with_gone(stats, gone).withColumn("removed_words", F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(lost).cast("long")).withColumn("base_failed", base_failed())
    depleted = F.col("n_words") - F.col("removed_words") < MIN_LEFT * F.col("n_words")
    verdict = out.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", (~F.col("base_failed") & ~depleted).alias("kept"))
    return verdict, gone


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents without their common lines, with the columns of docs.

    A kept document that loses no line is unchanged; n_chars, if there is one, follows the text.
    Both sides of the one join of texts are keyed by document, so no host or line is hot there.
    """
    verdict, gone = judge(docs)
    key = [F.col("doc_id").alias("_id"), F.col("source").alias("_host")]
    rejected = verdict.groupBy("doc_id", "source").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select(*key, F.lit(True).alias("_rejected"))
    fate = rejected.unionByName(gone.select(*key, F.col("gone").alias("_gone")), allowMissingColumns=True)
    fate = fate.groupBy("_id", "_host").agg(F.coalesce(F.max("_rejected"), F.lit(False)).alias("_rejected"), F.flatten(F.collect_list("_gone")).alias("_gone"))
    fate = fate.withColumn("_gone", F.when(F.size("_gone") > 0, F.col("_gone")))
    # The row goes along as one value, so that no column of docs can be taken for one of these.
    held = docs.select(F.col("doc_id").alias("_own_id"), F.col("source").alias("_own_host"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    joined = held.join(fate, F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_host").eqNullSafe(F.col("_host")), "left").where(~F.coalesce("_rejected", F.lit(False)))
    old = F.col("_doc")["text"]
    stays = F.filter(lines_of(old), lambda x: ~F.array_contains("_gone", line_hash(x)))
    out = joined.withColumn("_text", F.when(F.col("_gone").isNull() | old.isNull(), old).otherwise(F.array_join(stays, "\n")))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_doc")["n_chars"]).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
