"""Secret scans by patterns and character Markov models, in DataFrame functions only.

Three patterns find what is a secret by its form. Beyond them each long run of token characters is
read by first-order Markov models of random strings (one for each alphabet) and of ordinary
identifiers (one for each way to write them): it is a secret if the best random model is likelier
than the best ordinary one by LIMIT and SLACK a character. Log-probabilities are whole thousandths of a nat, so scores
are exact whatever the order of adding. Each row is scanned by itself; nothing of it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, need

# The base patterns. Runs that are too short are left out by the counts below; for
# access and hex a run is as long as it gets, so the count stands in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

#: What a run scored by the models consists of, and how long it is at least.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: In thousandths of a nat: a thousand ordinary runs to a random one, and what each character may
#: add where an ordinary run is of a language that the samples lack.
LIMIT, SLACK = round(1000 * math.log(1000)), 400
#: Distinct texts that ordinary identifiers are drawn from, and how many steps from a character
#: weigh as much as what is known of the next one without it.
SAMPLE, PRIOR = 500, 10.0
SPAN = "array<struct<start:int,kind:int,end:int>>"


def transitions(text: Column) -> Column:
    """The numbers of a text's steps from character to character, the first one from the start."""
    nth = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(nth, lambda n: F.filter(F.transform(n, lambda x, i: F.coalesce(F.get(n, i - 1), F.lit(0)) * len(ALPHABET) + F.nullif(x, F.lit(0)) - 1), lambda t: t.isNotNull()))


def train(samples: DataFrame, prior: float = PRIOR) -> dict[str, list[int]]:
    """A table of log-probabilities for each model, from labelled samples (text, model, random).

    A model's name begins with `random` or `ordinary` by its label. Only counts of steps are
    gathered, at most 68 x 67 a model, however many samples there are. Null and empty texts count
    for nothing; characters beyond ALPHABET are skipped. Without samples there are no models.
    """
    name = F.concat(F.when(F.col("random"), "random ").otherwise("ordinary "), F.col("model"))
    steps = need(samples, "text", "model", "random").select(name.alias("m"), F.explode(transitions(F.col("text"))).alias("t"))
    width, models = len(ALPHABET), {}
    counts: dict[str, dict[int, int]] = {}
    for m, t, n in steps.groupBy("m", "t").agg(F.count("*")).collect():
        counts.setdefault(m, {})[t] = n
    for m, seen in sorted(counts.items()):
        rows = [[seen.get(origin * width + k, 0) for k in range(width)] for origin in range(width + 1)]
        alone = [sum(column) + 0.5 for column in zip(*rows)]
        share = [n / sum(alone) for n in alone]
        models[m] = [round(1000 * math.log((n + prior * p) / (sum(row) + prior))) for row in rows for n, p in zip(row, share)]
    return models


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled samples (text, model, random) from a bounded number of distinct texts of docs.

    Ordinary ones are their words, base matches taken out first, as they stand and joined the ways
    identifiers are, numbers, and characters repeated; random ones are digests of the same texts in several alphabets.
    The texts are those with the smallest hashes, so repeats don't crowd the sample.
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    rows = need(docs, "text").where("text is not null").withColumn("_h", F.xxhash64("text"))
    last = rows.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    chosen = rows.where(F.col("_h") <= F.lit(last)).groupBy("_h").agg(F.first("text").alias("text")).withColumn("text", text)
    words = chosen.withColumn("w", F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)))
    starts = F.sequence(F.lit(0), F.size("w") - 3, F.lit(3))
    trios = words.where(F.size("w") > 2).select("_h", F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), *[F.lower(F.get("w", i + k)).alias(f"w{k}") for k in range(3)]))).alias("t")).select("_h", "t.*")
    three = [F.col(f"w{k}") for k in range(3)]
    mark = F.sha2(F.concat_ws("-", "_h", "i"), 256)
    number = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")
    few = F.when(number % 3 == 0, F.concat(F.lit("-"), number % 2100)).otherwise("")
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (number % 20_000).cast("int")), "yyyy-MM-dd")
    # Four digests of 64 bytes, without the padding between them, so that rare steps are seen too.
    base64 = F.base64(F.unhex(F.concat(*[F.sha2(F.concat_ws("-", "_h", "i", F.lit(k)), 512) for k in range(4)])))
    base62 = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    made = [
        ("snake", False, F.concat(F.concat_ws("_", *three), F.translate(few, "-", "_"))), ("snake", False, F.concat(F.concat_ws("-", *three), few)), ("snake", False, F.concat(F.lit("/"), F.concat_ws("/", *three), few)),
        ("camel", False, F.concat(three[0], F.initcap(three[1]), F.initcap(three[2]))), ("camel", False, F.concat(F.initcap(three[0]), F.initcap(three[1]), F.translate(few, "-", ""))), ("upper", False, F.concat_ws("_", *[F.upper(t) for t in three])),
        ("repeat", False, F.repeat(F.substring(mark, 1, 1), 24)), ("repeat", False, F.repeat(F.substring(three[0], 1, 2), 12)), ("repeat", False, F.repeat(F.get(F.array(*map(F.lit, "+/_=-xX")), (number % 7).cast("int")), 24)),
        ("digits", False, F.concat(number % 1_000_003, number)), ("digits", False, day), ("joined", False, F.concat(*three)), ("joined", False, F.concat(F.initcap(three[0]), *three[1:])),
        ("hex", True, mark), ("base64", True, base64), ("base62", True, base62), ("lower", True, F.lower(base62)), ("upper", True, F.upper(base62)),
    ]
    # Each three words make one sample, the ways taking turns.
    ways = F.array(*[F.struct(t.alias("text"), F.lit(m).alias("model"), F.lit(r).alias("random")) for m, r, t in made])
    joined = trios.select(F.get(ways, (F.col("i") / 3 + F.abs("_h") % 97).cast("int") % len(made)).alias("s")).select("s.*")
    return joined.unionByName(words.select(F.explode("w").alias("text"), F.lit("joined").alias("model"), F.lit(False).alias("random")))


def margin(run: Column, models: dict[str, list[int]]) -> Column:
    """How much likelier a run is under the best random model than under the best ordinary one, in
    thousandths of a nat; null where there is no model of both labels."""
    groups = [[t for m, t in models.items() if m.startswith(label)] for label in ("random", "ordinary")]
    if not all(groups):
        return F.lit(None).cast("long")

    def best(steps: Column, tables: list[list[int]]) -> Column:
        return F.array_max(F.array(*[under(steps, t) for t in tables]))

    def under(steps: Column, table: list[int]) -> Column:
        # A table is one foldable text, which the optimiser reads once into an array.
        held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, t: s + F.get(held, t))

    return let(transitions(run), lambda s: best(s, groups[0]) - best(s, groups[1]))


def places(text: Column, pattern: str, kind: str, keep) -> Column:
    """The spans of a pattern's matches that keep(match, group) holds for, in code points.

    Gaps between matches and matches take turns, so one fold over their lengths gives the places.
    """
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        taken = x["m"].isNotNull() & F.coalesce(keep(x["m"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(taken, F.concat(held["out"], F.array(span))).otherwise(held["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(found, zero, step, lambda held: held["out"])).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The spans of the three patterns, by start and then by kind."""
    assigned = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGNED
    everything = lambda m: F.lit(True)
    return F.sort_array(F.concat(places(text, ASSIGN, "assign", assigned), places(text, ACCESS, "access", everything), places(text, HEX, "hex", everything)))


def scan(docs: DataFrame, models: dict[str, list[int]], text: str = "text", base: str = "base", spans: str = "spans", limit: int = LIMIT, slack: int = SLACK) -> DataFrame:
    """docs with two columns of spans (start, kind by its place in KINDS, end; code points, end
    exclusive): those of the patterns, and these with the models' ones.

    A run inside a span of a pattern adds none. Null and empty texts have no spans. Rows are
    independent: repeated ones get the same spans, a very long text is folded in one pass, and
    columns of docs named like the two new ones are replaced. Without models only patterns count.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn(base, base_spans(value))
    random = places(value, RUN, "random", lambda m: margin(m, models) >= limit + slack * F.length(m))
    beyond = F.filter(random, lambda r: ~F.exists(F.col(f"`{base}`"), lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    return out.withColumn(spans, F.sort_array(F.concat(F.col(f"`{base}`"), beyond)))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[secret]") -> DataFrame:
    """docs of `scan` with every span of the text replaced by mark, overlapping ones by one."""
    value = F.col(f"`{text}`")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held: Column, s: Column) -> Column:
        new = s["start"] >= held["at"]
        piece = F.concat(held["out"], F.substr(value, held["at"] + 1, s["start"] - held["at"]), F.lit(mark))
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), F.when(new, piece).otherwise(held["out"]).alias("out"))

    done = F.aggregate(F.col(f"`{spans}`"), zero, step, lambda held: F.concat(held["out"], F.substr(value, held["at"] + 1, F.length(value))))
    return docs.withColumn(text, F.when(F.size(F.col(f"`{spans}`")) > 0, done).otherwise(value))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of each document, by models
    trained on docs' own labelled samples."""
    found = scan(need(docs, "doc_id", "text"), train(labelled(docs)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), count("random"))
