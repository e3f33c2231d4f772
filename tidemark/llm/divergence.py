"""Source divergence audit: how far the term use of a language's sources lies apart, exactly.

Terms whose counts are the same in every source of a language form one count column. Each pair of
sources is compared once for each distinct column, times the number of its terms; only the ranks
of single terms go back to the terms. All numbers are whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, met, need, small

#: A term is a longest run of letters of any script, and of whatever else lies beyond ASCII.
TERM, CAPITALS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile("[A-Z]+")
#: Documents of a language that a term must be in; what is added to each count; the scale of shares.
LEAST, PRIOR, SCALE = 30, 5, 1_000_000_000
TOP = 50
#: Sources compared with all others of their language in one task; terms or shares held at a time.
BLOCK, HELD = 256, 1 << 19


def term_counts(rows: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of rows (lang, source, text): partial counts, to be added up.

    A task adds up what it reads and gives it on whenever it holds HELD terms.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                text = text.as_py() or ""
                # Only A to Z are lower-cased, so nothing else may be.
                words = TERM.findall(text.lower() if text.isascii() else CAPITALS.sub(lambda m: m[0].lower(), text))
                if words:
                    n, docs = sums.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                    n.update(words)
                    docs.update(set(words))
            if sum(len(n) for n, _ in sums.values()) > HELD:
                yield from given(sums)
                sums = {}
        yield from given(sums)

    def given(sums: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in sums.items():
            terms = list(n)
            for at in range(0, len(terms), 1 << 16):
                part = terms[at : at + (1 << 16)]
                columns = {"lang": [lang] * len(part), "source": [source] * len(part), "term": part, "n": [n[t] for t in part], "docs": [docs[t] for t in part]}
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR terms)), exact for counts beyond what a long
    times SCALE holds; null where there is no term."""
    whole = lambda c: c.cast("decimal(25,0)")
    over, under = whole(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + PRIOR * terms)
    return F.when(terms > 0, 1 + F.call_function("div", over, under))


def counted(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three saved tables: kept terms (lang, term, n, column), groups (lang, source, nth, n) and
    languages (lang, n, terms, sources).

    A column is the sorted array of (source, count) of the sources that have the term, at most one
    entry a source. A frequent term is counted in the tasks before it is shuffled.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    sums = term_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    column = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column")
    terms = scratch.save(sums.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("_docs"), column).where(F.col("_docs") >= least).drop("_docs"))
    used = terms.select("lang", F.explode("column").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    pairs = rows.select("lang", "source").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = scratch.save(pairs.join(used, ["lang", "source"], "left").select("lang", "source", nth.alias("nth"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    sizes = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("sources"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = scratch.save(sizes.join(kept, "lang", "left").select("lang", "n", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), "sources"))
    return terms, groups, langs


def distances(terms: DataFrame, groups: DataFrame, langs: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, a, b, value: for each two sources, by their places, the sum over all kept terms of the
    difference of their shares. Languages with two sources or more only.

    Each distinct column becomes one dense row of shares; a task holds `block` sources' sums with all
    others of one language at a time, and languages of more sources go in several blocks.
    """
    columns = terms.groupBy("lang", "column").agg(F.count("*").alias("times"))
    # One column of no term for each language, so that all its pairs come out.
    none = langs.select("lang", F.array().cast(terms.schema["column"].dataType).alias("column"), F.lit(0).cast("long").alias("times"))
    sources = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("nth", "source", "n"))).alias("sources"))
    known = sources.join(langs.select("lang", "terms").where("sources > 1"), "lang")
    rows = met(columns.unionByName(none), known, ["lang"], F.col("column"))
    held = F.map_from_entries("column")
    dense = F.transform(F.array(held), lambda m: F.transform("sources", lambda s: F.coalesce(share(F.coalesce(F.try_element_at(m, s["source"]), F.lit(0)), s["n"], F.col("terms")), F.lit(0))))[0]
    blocks = F.sequence(F.lit(0), F.floor((F.size("sources") - 1) / block).cast("int"))
    dealt = rows.select("lang", F.explode(blocks).alias("block"), "times", dense.alias("p"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, None
        for batch in batches:
            for key, part in batch.groupby(["lang", "block"], sort=False):
                if key != at:
                    if at is not None:
                        yield flat(at, sums)
                    at, sums = key, 0
                step = max(1, HELD // len(part["p"].iloc[0]))
                for k in range(0, len(part), step):
                    p, times = np.stack(part["p"].iloc[k : k + step].to_list()), part["times"].to_numpy()[k : k + step]
                    own = range(key[1] * block, min(key[1] * block + block, p.shape[1]))
                    sums = sums + np.stack([times @ np.abs(p - p[:, [i]]) for i in own])
        if at is not None:
            yield flat(at, sums)

    def flat(key: tuple, sums: np.ndarray) -> pd.DataFrame:
        a, b = (i.ravel() for i in np.indices(sums.shape))
        return pd.DataFrame({"lang": key[0], "a": a + key[1] * block, "b": b, "value": sums.ravel()})

    partial = dealt.sortWithinPartitions("lang", "block").mapInPandas(compare, "lang string, a long, b long, value long")
    return partial.where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others of its language.

    docs: text, lang, source; further columns are not read. Nulls count as empty texts. Part
    `pair`: every other source, farthest first. Part `term`: the `top` terms that the source has
    and uses more than its language does. Ties go by the bytes of the item. Sources without kept
    terms have pairs and no terms; a language of one source has no pairs; without documents there
    are no rows. A repeated row counts again. A very long text is one list of its terms.
    """
    scratch = Scratch(docs.sparkSession)
    terms, groups, langs = counted(need(docs, "text", "lang", "source"), scratch, least)
    name = groups.select("lang", F.col("nth").cast("long").alias("a"), "source")
    other = groups.select("lang", F.col("nth").cast("long").alias("b"), F.col("source").alias("item"))
    far = distances(terms, groups, langs, block).join(small(name), ["lang", "a"]).join(small(other), ["lang", "b"])
    pairs = far.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rows = terms.select("lang", "term", F.col("n").alias("all"), F.explode("column").alias("c")).select("lang", "term", "all", "c.source", "c.n")
    totals = groups.select("lang", "source", F.col("n").alias("own")).join(langs.select("lang", F.col("n").alias("total"), "terms"), "lang")
    shares = met(rows, totals, ["lang", "source"], F.col("term")).withColumn("p", share(F.col("n"), F.col("own"), F.col("terms"))).withColumn("q", share(F.col("all"), F.col("total"), F.col("terms")))
    used = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")
