"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one vertex. Every vertex gets 64 minwise values. In each of
several independent trees a vertex walks a path: at every node a coordinate that the node's name
selects, and the vertex's minwise value there is its branch. Rows sorted by path are the tree; a
node of few vertices is compared exhaustively, a larger one branches on, and one that is still
large at the last level is compared with a pivot and, for those unlike the pivot, with all.
Comparison is by sketches. Links are then confirmed on full shingle sets: all pairs of a small
candidate component at one place, the links of a large one edge by edge, and of what that leaves
unconnected every pair that is alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SHINGLE, Scratch, met, need, small

COORDINATES, LEVELS = 64, 4
#: Nodes of up to SMALL vertices are compared exhaustively, at any level.
SMALL = 48
#: A node of more rows than HOT is dealt out by its children, and in blocks at the last level.
HOT = 512
#: Vertices of a candidate component whose texts meet at one place, and of a hub's links.
BLOCK = 300
#: Rows of nodes that one task compares, about.
TASK_ROWS = 8_192
#: Links that a task holds before it passes them on.
HELD = 100_000
#: At the threshold itself, the share of pairs that the sketches, and that the trees, may miss.
SKETCH_MISS, TREE_MISS = 1e-4, 0.003
#: Remembered word hashes of one worker.
REMEMBERED = 500_000

SEEDS = np.random.default_rng(20_240_101).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def agreement(percent: int) -> float:
    """The share of the sketch that must agree in a candidate pair.

    The values that agree of a pair at the threshold are binomial; a pair is taken from the
    largest number on that misses at most SKETCH_MISS of such pairs.
    """
    p, missed, k = percent / 100, 0.0, 0
    while k < COORDINATES:
        missed += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if missed > SKETCH_MISS:
            break
        k += 1
    return k / COORDINATES


def trees_for(percent: int) -> int:
    """How many trees miss at most TREE_MISS of the pairs at the threshold, if all their nodes
    were to branch down to the last level."""
    together = (percent / 100) ** LEVELS
    return 1 if together >= 1 else math.ceil(math.log(TREE_MISS) / math.log(1 - together))


AGREE = agreement(85)


class WordHashes(dict):
    """Words to 64-bit hashes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * FINAL
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of five words, A to Z in lower case.

    With fewer words, the whole sequence is the one shingle; without words there is none.
    """
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(HASHES.__getitem__, split), np.uint64, len(split))
    width = min(SHINGLE, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * STEP + w[k : len(w) - width + 1 + k]
    return np.unique(mixed(h))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least value of a set under each coordinate's hash, 32 bits each."""
    return np.array([((s * a) >> np.uint64(32)).min() for a in SEEDS], np.uint64) if len(s) > 4096 else ((SEEDS[:, None] * s) >> np.uint64(32)).min(1)


def paths(values: np.ndarray, trees: int) -> np.ndarray:
    """Node names, one for each vertex, tree and level, from the vertices' minwise values."""
    n = len(values)
    out = np.empty((n, trees, LEVELS), np.uint64)
    rows = np.arange(n)
    for t in range(trees):
        node = np.full(n, t + 1, np.uint64)
        for level in range(LEVELS):
            pick = np.full(n, t % COORDINATES) if level == 0 else (mixed(node * STEP) % np.uint64(COORDINATES)).astype(np.int64)
            node = mixed(node * STEP + values[rows, pick] + np.uint64(level))
            out[:, t, level] = node
    return out


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def features(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, text_key, n_shingles, print_a, print_b, sketch, path for each row; path: trees *
    LEVELS names; text_key: which of an id's texts it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "n_shingles", "print_a", "print_b", "sketch", "path"]
        with np.errstate(over="ignore"):
            for b in batches:
                sizes, prints, values = [], [], []
                for text in b.column("text").to_pylist():
                    s = shingle_set(text)
                    sizes.append(len(s))
                    prints.append((int(mixed(s).sum(dtype=np.uint64)), int(mixed(s + STEP).sum(dtype=np.uint64))) if len(s) else (0, 0))
                    values.append(minwise(s) if len(s) else np.zeros(COORDINATES, np.uint64))
                n = len(sizes)
                if not n:
                    continue
                v = np.stack(values)
                sketch = (v & np.uint64(255)).astype(np.uint8)
                flat = paths(v, trees).reshape(-1).astype(np.int64)
                offsets = np.arange(0, n * trees * LEVELS + 1, trees * LEVELS, dtype=np.int32)
                p = np.array(prints, np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array([r.tobytes() for r in sketch], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names,
                )

    slim = need(docs, "doc_id", "text").select("doc_id", text_key().alias("text_key"), "text")
    return slim.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, print_a long, print_b long, sketch binary, path array<long>")


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, from batches that are sorted by key."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        change = (b[keys] != b[keys].shift()).any(axis=1).to_numpy()
        change[0] = bool(held) and (held[-1][keys].iloc[-1] != b[keys].iloc[0]).any()
        cuts = np.flatnonzero(change)
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(b.iloc[start:cut])
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held, start = [], cut
        held.append(b.iloc[start:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def alike(sketches: np.ndarray, i: int) -> np.ndarray:
    """How much of each sketch agrees with the i-th."""
    return (sketches == sketches[i]).mean(axis=1)


def node_links(paths_: np.ndarray, sketches: np.ndarray, level: int, rows: np.ndarray, agree: float = AGREE) -> Iterator[tuple[int, int]]:
    """Candidate links of a node, a spanning forest of those found, as positions."""
    if len(rows) < 2:
        return
    own = sketches[rows]
    if len(rows) <= SMALL:
        groups = Groups(len(rows))
        for i in range(len(rows) - 1):
            for j in np.flatnonzero(alike(own[i:], 0) >= agree)[1:] + i:
                if groups.join(i, j):
                    yield rows[i], rows[j]
    elif level < LEVELS:
        order = np.argsort(paths_[rows, level], kind="stable")
        cuts = np.flatnonzero(np.diff(paths_[rows[order], level])) + 1
        for child in np.split(rows[order], cuts):
            yield from node_links(paths_, sketches, level + 1, child, agree)
    else:
        groups = Groups(len(rows))
        near = alike(own, 0) >= agree
        for j in np.flatnonzero(near)[1:]:
            groups.join(0, j)
            yield rows[0], rows[j]
        for i in np.flatnonzero(~near):
            for j in np.flatnonzero(alike(own, i) >= agree):
                if groups.join(i, j):
                    yield rows[i], rows[j]


def frames(pairs: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Links as frames of bounded size."""
    while held := list(islice(pairs, HELD)):
        yield pd.DataFrame(held, columns=["a", "b"])


def tasks_for(rows: int, spark) -> int:
    return max(1, min(-(-rows // TASK_ROWS), 1 << 16), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 1024))


def candidates(vertices: DataFrame, scratch: Scratch, percent: int = 85) -> DataFrame:
    """a, b: candidate links between vertices, from all trees; enough to connect what is alike.

    vertices: vertex, sketch, path.
    """
    agree, n_trees = agreement(percent), trees_for(percent)
    level = lambda k: F.get(F.col("path"), F.col("tree") * LEVELS + k)
    trees = vertices.select("vertex", "sketch", "path", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    names = [f"p{k}" for k in range(LEVELS)]
    rows = trees.select("vertex", "sketch", *[level(k).alias(name) for k, name in enumerate(names)])

    def links(dealt: DataFrame, below: int, n: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for node in runs(batches, ["deal"]):
                sketches = np.frombuffer(b"".join(node["sketch"]), np.uint8).reshape(-1, COORDINATES)
                found = node_links(node[names].to_numpy(), sketches, below, np.arange(len(node)), agree)
                docs = node["vertex"].to_numpy()
                yield from frames((docs[i], docs[j]) for i, j in found)

        return dealt.repartition(tasks_for(n, scratch.spark), "deal").sortWithinPartitions("deal", "vertex").mapInPandas(run, "a long, b long")

    found = []
    for k, name in enumerate(names):
        # Nodes of one vertex have nothing to compare; the others' rows alone are moved. A node
        # that is too large for a task branches here as it would there.
        sizes = scratch.save(rows.groupBy(name).count().where(F.col("count") > 1))
        hot = scratch.save(sizes.where(F.col("count") > HOT).select(name))
        any_hot = not hot.isEmpty()
        cold = sizes.where(F.col("count") <= HOT)
        n = cold.agg(F.sum("count")).first()[0] or 0
        found.append(scratch.save(links(rows.join(cold.select(name), name).withColumn("deal", F.col(name)), k + 1, n)))
        scratch.drop(sizes)
        if not any_hot:
            break
        rows = scratch.save(met(rows, hot, [name], F.col("vertex")))
    else:
        found.append(leaf_links(rows.select("vertex", "sketch", F.col(names[-1]).alias("leaf")), scratch, agree))
    return reduce(DataFrame.unionByName, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def leaf_links(rows: DataFrame, scratch: Scratch, agree: float = AGREE) -> DataFrame:
    """a, b: candidate links of last nodes that are too large for a task, enough to connect all
    that is alike in each.

    rows: vertex, sketch, leaf. As in node_links every vertex meets its leaf's pivot, and those
    unlike the pivot meet all: in chunks, each against every block of the leaf.
    """
    pivots = scratch.save(rows.groupBy("leaf").agg(F.min(F.struct("vertex", "sketch")).alias("first")).select("leaf", F.col("first.vertex").alias("pivot"), F.col("first.sketch").alias("pivot_sketch")))

    def meet_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, pivot = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, COORDINATES) for c in ("sketch", "pivot_sketch"))
            yield b.drop(columns="pivot_sketch").assign(near=(own == pivot).mean(axis=1) >= agree)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["deal"]):
            sketches = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, COORDINATES)
            docs, groups = g["vertex"].to_numpy(), Groups(len(g))
            hits = ((i, j) for i in np.flatnonzero(g["far"]) for j in np.flatnonzero(alike(sketches, i) >= agree))
            yield from frames((docs[i], docs[j]) for i, j in hits if groups.join(i, j))

    seen = met(rows, pivots, ["leaf"], F.col("vertex")).select("vertex", "sketch", "leaf", "pivot", "pivot_sketch")
    seen = scratch.save(seen.mapInPandas(meet_pivot, "vertex long, sketch binary, leaf long, pivot long, near boolean"))
    near = seen.where("near").select(F.col("pivot").alias("a"), F.col("vertex").alias("b"))
    return near.unionByName(dealt(seen.drop("pivot"), scratch, HOT, HOT).mapInPandas(meet, "a long, b long"))


def dealt(rows: DataFrame, scratch: Scratch, block: int, chunk: int) -> DataFrame:
    """rows: vertex, sketch, leaf, near and further columns, dealt so that those of a leaf that are
    not near meet all of it: in chunks, as far, each against every block. One deal is one place,
    in order."""
    deals = rows.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("near")) / chunk).cast("int").alias("chunks"))
    seats = met(rows, scratch.save(deals.where("chunks > 0")), ["leaf"], F.col("vertex"))
    seats = seats.withColumn("block", F.pmod(F.xxhash64("vertex", F.lit(1)), F.col("blocks"))).withColumn("chunk", F.pmod(F.xxhash64("vertex", F.lit(2)), F.col("chunks")))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    own = [c for c in rows.columns if c not in ("leaf", "near")]
    sat = seats.withColumn("to", every("chunks")).select(*own, F.lit(False).alias("far"), F.xxhash64("leaf", "block", "to").alias("deal"))
    calls = seats.where("not near").withColumn("to", every("blocks")).select(*own, F.lit(True).alias("far"), F.xxhash64("leaf", "to", "chunk").alias("deal"))
    return sat.unionByName(calls).repartition("deal").sortWithinPartitions("deal", "vertex", "far")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """vertex, root: the least vertex that each vertex with a link can reach.

    Alternating star contraction: vertices hang themselves and their larger neighbours on the
    least neighbour until nothing moves. Rounds grow with the logarithm of the vertices.
    """
    now = scratch.save(edges.select("a", "b"))
    while True:
        # Large star: larger neighbours of a vertex go to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), "m").where("a <> m").distinct()
        # Small star: a vertex and its smaller neighbours go to the least of them.
        low = large.groupBy("a").agg(F.min("m").alias("m0")).select(F.col("a").alias("u"), "m0")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m0").alias("b")), F.struct(F.col("m").alias("a"), F.col("m0").alias("b")))).alias("e"))
        after = scratch.save(small.select(F.col("e.b").alias("a"), F.col("e.a").alias("b")).where("a <> b").distinct())
        moved = after.exceptAll(now).limit(1).count() + now.exceptAll(after).limit(1).count()
        scratch.drop(now)
        now = after
        if not moved:
            break
    pairs = now.select(F.col("b").alias("vertex"), F.col("a").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("vertex"), "root")).groupBy("vertex").agg(F.min("root").alias("root"))


def confirmed(grouped: DataFrame, percent: int) -> DataFrame:
    """a, b: links with percent * union <= 100 * intersection of full sets.

    grouped: deal, vertex, hub, sketch, text; rows with one deal meet in one task. With a hub its
    links to all others of the deal are looked at; without one all pairs, and a spanning forest
    of their links is given.
    """
    agree = agreement(percent)

    def linked(g: pd.DataFrame) -> Iterator[tuple]:
        docs, hubs, texts, sets = g["vertex"].to_numpy(), np.flatnonzero(g["hub"]), g["text"].to_numpy(), {}
        groups = Groups(len(docs))

        def of_doc(i):
            if i not in sets:
                sets[i] = shingle_set(texts[i])
            return sets[i]

        def enough(i, j):
            x, y = of_doc(i), of_doc(j)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        if len(hubs):
            for j in np.flatnonzero(~g["hub"].to_numpy()):
                if enough(hubs[0], j):
                    yield docs[hubs[0]], docs[j]
                sets.pop(j, None)
            return
        sketches = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, COORDINATES)
        for i in range(len(docs)):
            for j in np.flatnonzero(alike(sketches[i:], 0) >= agree)[1:] + i:
                if groups.find(i) != groups.find(j) and enough(i, j):
                    groups.join(i, j)
                    yield docs[i], docs[j]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for g in runs(batches, ["deal"]):
                yield from frames(linked(g))

    placed = grouped.repartition("deal").sortWithinPartitions("deal", "vertex")
    return ordered(placed.mapInPandas(run, "a long, b long"))


def ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")


def confirmed_between(apart: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """a, b: links that connect parts of a component wherever any pair that is alike would.

    apart: vertex, sketch, leaf (the component), part, near (in its largest part). texts: vertex,
    text. Vertices outside the largest part meet all others by sketches first; only those of a
    deal that are alike to one of another part send their texts there, once each, however many
    they are alike to. A pair is looked at unless links of the same deal connect it already.
    """
    agree = agreement(percent)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["deal"]):
            sketches, part = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, COORDINATES), g["part"].to_numpy()
            used = np.zeros(len(g), bool)
            for i in np.flatnonzero(g["far"]):
                hits = (alike(sketches, i) >= agree) & (part != part[i])
                used |= hits
                used[i] |= hits.any()
            yield g[used][["deal", "vertex", "sketch", "part", "far"]]

    def linked(g: pd.DataFrame) -> Iterator[tuple]:
        docs, part, texts_, far, sets = g["vertex"].to_numpy(), g["part"].to_numpy(), g["text"].to_numpy(), g["far"].to_numpy(), {}
        sketches = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, COORDINATES)
        groups, first = Groups(len(g)), {}
        for i, p in enumerate(part):
            groups.join(i, first.setdefault(p, i))
        for i in np.flatnonzero(far):
            own = shingle_set(texts_[i])
            for j in np.flatnonzero(alike(sketches, i) >= agree):
                if groups.find(i) == groups.find(j):
                    continue
                if j not in sets:
                    sets[j] = shingle_set(texts_[j])
                both = len(np.intersect1d(own, sets[j], assume_unique=True))
                if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                    groups.join(i, j)
                    yield docs[i], docs[j]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for g in runs(batches, ["deal"]):
                yield from frames(linked(g))

    meeting = scratch.save(dealt(apart, scratch, 4 * HOT, HOT).mapInPandas(wanted, "deal long, vertex long, sketch binary, part long, far boolean"))
    seats = meeting.join(texts, "vertex").repartition("deal").sortWithinPartitions("deal", "vertex", "far")
    return ordered(seats.mapInPandas(run, "a long, b long"))


def confirmed_edges(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b: the edges that hold on full sets, looked at one by one.

    texts: vertex, sketch, text. The vertex with more links is the edge's hub; its text meets
    those of its other ends in groups of about BLOCK, so it moves once a group.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count()
    degrees = ends.select("v", F.col("count").alias("d"))
    both = edges.join(degrees.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degrees.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    at_a = F.col("da") >= F.col("db")
    hung = both.select(F.when(at_a, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(at_a, F.col("b")).otherwise(F.col("a")).alias("vertex"), F.greatest("da", "db").alias("d"))
    hung = hung.withColumn("deal", F.xxhash64("h", F.pmod(F.xxhash64("vertex"), F.ceil(F.col("d") / BLOCK))))
    hubs = hung.select("deal", F.col("h").alias("vertex")).distinct().withColumn("hub", F.lit(True))
    seats = hung.select("deal", "vertex").withColumn("hub", F.lit(False)).unionByName(hubs)
    return confirmed(seats.join(texts, "vertex"), percent)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets.
    component_id is the least id that a document reaches by links; kept is doc_id = component_id.
    Trees and sketch agreement follow from percent, for the misses SKETCH_MISS and TREE_MISS.
    A text without words (or null) has no shingles and is its own component. Rows that repeat an
    id are one document with the links of all its texts and share its fate; a null id is linked
    with nothing and kept. Ids may be of any type that can be ordered. Runs jobs when called.
    """
    scratch = Scratch(docs.sparkSession)
    made = scratch.save(features(docs, trees_for(percent)))
    linked = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = ["n_shingles", "print_a", "print_b"]
    classes = linked.groupBy(*same).agg(F.min("doc_id").alias("first"))
    # A class is named by its least id, or by a hash where several share that, as the texts of one
    # id do, or where ids are no numbers.
    alone = F.count("*").over(Window.partitionBy("first")) == 1
    hashed = F.xxhash64("first", *same)
    number = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    classes = scratch.save(classes.withColumn("vertex", F.when(alone, F.col("first").cast("long")).otherwise(hashed) if number else hashed))
    members = scratch.save(linked.select("doc_id", *same).join(classes, same).select("doc_id", "vertex").distinct())
    vertices = linked.join(classes, same).where("doc_id = first").dropDuplicates(["vertex"])
    vertices = scratch.save(vertices.select("vertex", "first", "text_key", "sketch", "path"))
    edges = scratch.save(candidates(vertices.select("vertex", "sketch", "path"), scratch, percent))
    links = confirm(docs, vertices, edges, scratch, percent)
    # An id with several texts joins their classes.
    several = members.groupBy("doc_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("z")).where("a <> z").select("doc_id", "a")
    final = components(links.unionByName(members.join(several, "doc_id").where("vertex <> a").select("a", F.col("vertex").alias("b"))), scratch)
    out = members.withColumnRenamed("vertex", "v").join(final, F.col("v") == F.col("vertex"), "left").select("doc_id", F.coalesce("root", "v").alias("root"))
    least = out.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = out.distinct().join(least, "root").select(F.col("doc_id").alias("_id"), "component_id")
    every = made.select("doc_id", "n_shingles").join(ids, F.col("doc_id") == F.col("_id"), "left")
    return every.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document, that of the least id, of each group of near-duplicates."""
    fate = Scratch(docs.sparkSession).save(near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(small(fate), docs["doc_id"] == fate["_gone"], "left_anti")


def confirm(docs: DataFrame, vertices: DataFrame, edges: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """a, b: confirmed links that connect all that any confirmed candidate would.

    The vertices of a candidate component of up to BLOCK meet in one group, each text moved once.
    Of a larger one the edges are looked at. Edges are only a forest of what is alike, so where
    they don't hold the component together, what is outside its largest part meets all of it.
    """
    roots = scratch.save(components(edges, scratch))
    sizes = roots.groupBy("root").count()
    seated = scratch.save(roots.join(sizes, "root").select("vertex", "root", (F.col("count") > BLOCK).alias("large")))
    # Texts of vertices with a candidate alone are moved; the rest stay unread beyond their id.
    wanted = scratch.save(vertices.join(seated, "vertex").select("vertex", F.col("first").alias("_id"), F.col("text_key").alias("_key"), "root", "large", "sketch"))
    own = need(docs, "doc_id", "text").withColumn("_own", text_key())
    texts = own.join(small(wanted), (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_key"))).select("vertex", "root", "large", "sketch", "text")
    texts = scratch.save(texts.dropDuplicates(["vertex"]))
    few = texts.where(~F.col("large")).select(F.col("root").alias("deal"), "vertex", F.lit(False).alias("hub"), "sketch", "text")
    first = scratch.save(confirmed(few, percent))
    large = seated.where("large")
    if large.isEmpty():
        return first
    bodies = texts.where("large").select("vertex", "sketch", "text")
    held = scratch.save(confirmed_edges(edges.join(large.select(F.col("vertex").alias("a")), "a", "left_semi"), bodies, percent))
    part = components(held, scratch)
    parts = scratch.save(large.join(part.select("vertex", F.col("root").alias("to")), "vertex", "left").select("vertex", "root", F.coalesce("to", "vertex").alias("part")))
    mains = parts.groupBy("root", "part").count().groupBy("root").agg(F.max(F.struct("count", "part"))["part"].alias("main"), F.count("*").alias("n_parts")).where("n_parts > 1")
    apart = met(parts, scratch.save(mains), ["root"], F.col("vertex")).join(vertices.select("vertex", "sketch"), "vertex")
    apart = scratch.save(apart.select("vertex", "sketch", F.col("root").alias("leaf"), "part", (F.col("part") == F.col("main")).alias("near")))
    if apart.isEmpty():
        return first.unionByName(held)
    second = scratch.save(confirmed_between(apart, bodies.select("vertex", "text"), scratch, percent))
    return first.unionByName(held).unionByName(second)
