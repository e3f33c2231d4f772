"""Leaderboard files to rows of model, board, score, bounds, and the arithmetic that boards need."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.session import few


def zipped_csv(archives: DataFrame) -> DataFrame:
    """path, member, record (column to text): the lines of the CSV files in zip archives.

    archives: path, content, as binaryFile reads them. One archive is read at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".csv")):
                        with z.open(name) as f:
                            lines = list(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")))
                        yield pd.DataFrame({"path": path, "member": name, "record": [{k: v for k, v in r.items() if k} for r in lines]})

    return archives.select("path", "content").mapInPandas(run, "path string, member string, record map<string,string>")


def plain_csv(files: DataFrame) -> DataFrame:
    """path, nth, record (column to text): the records of CSV bodies (path, body), quoted fields
    with line breaks included. A body is read at a time; an empty one has no records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, body in zip(b["path"], b["body"], strict=True):
                lines = list(csv.DictReader(io.StringIO((body or "").removeprefix("\ufeff"), newline="")))
                yield pd.DataFrame({"path": path, "nth": range(len(lines)), "record": [{k: v for k, v in r.items() if isinstance(k, str) and k} for r in lines]})

    return files.select("path", "body").mapInPandas(run, "path string, nth int, record map<string,string>")


def pinned_board(spark: SparkSession, root: str, revision: str, config: str, category: str) -> DataFrame:
    """model, board, score, low, high, place of one category of a data set's configuration at a
    revision: root/revision/config holds its parquet. Rows without a rating are left out."""
    rows = spark.read.parquet(f"{root}/{revision}/{config}").where(F.col("category") == category)
    out = scored(rows, F.col("model_name"), F.lit(f"{config}/{category}"), F.col("rating"))
    bounds = rows.select(F.col("model_name").alias("model"), F.col("rating_lower").alias("low"), F.col("rating_upper").alias("high"))
    return ranked(out.drop("low", "high").join(bounds, "model"))


#: Pages that one source is asked for at most.
PAGES = 20
PAGE = "struct<data:array<struct<slug:string,name:string,score:double>>,has_more:boolean>"


def paged_json(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """source, model, name, score of the JSON pages (source, page, body) of each source: from page 1
    on, as long as the page before says that there is more, `most` at most. Null scores are left
    out; a slug becomes lower case with single hyphens for what is neither letter nor digit."""
    parsed = pages.where(F.col("page").between(1, most)).select("source", "page", F.from_json("body", PAGE).alias("p"))
    before = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    # A page that is missing ends the list as one that says so does.
    more = F.coalesce(F.col("p.has_more"), F.lit(False))
    reached = parsed.withColumn("_all", F.coalesce(F.bool_and(more).over(before), F.lit(True))).withColumn("_n", F.count("*").over(before)).where(F.col("_all") & (F.col("_n") == F.col("page") - 1))
    rows = reached.select("source", F.explode("p.data").alias("r")).where("r.score is not null")
    return rows.select("source", F.regexp_replace(F.lower("r.slug"), "[^a-z0-9-]+", "-").alias("model"), "r.name", "r.score")


def harness_board(bodies: DataFrame) -> DataFrame:
    """source, model, configuration, score, low, high, place of JSON boards (source, body): systems
    are a model in a harness, which is part of the configuration; 1224 places by pass rate."""
    row = "struct<model:string,harness:string,reasoning_effort:string,pass_rate:double,ci_lo:double,ci_hi:double>"
    rows = bodies.select("source", F.explode(F.from_json("body", f"struct<rows:array<{row}>>")["rows"]).alias("r")).where("r.pass_rate is not null")
    slug = F.regexp_replace(F.regexp_replace(F.lower("r.harness"), "[^a-z0-9]+", "-"), "^-|-$", "")
    effort = F.lower(F.nullif(F.trim("r.reasoning_effort"), F.lit("")))
    out = rows.select("source", "r.model", F.concat_ws("+", effort, F.concat(F.lit("harness-"), slug)).alias("configuration"), F.col("r.pass_rate").alias("score"), F.col("r.ci_lo").alias("low"), F.col("r.ci_hi").alias("high"))
    return out.withColumn("place", F.rank().over(Window.partitionBy("source").orderBy(F.col("score").desc())).cast("long"))


class PagedSource(DataSource):
    """`spark.read.format("paged_json")`: the pages of sources that are asked page by page.

    Options: sources (JSON: name to an address with {page}) and most. Each source is a partition,
    read by one task in order until a page says that there is no more.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "source string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(json.loads(self.options["sources"]), int(self.options.get("most", PAGES)))


class PagedReader(DataSourceReader):
    def __init__(self, sources: dict[str, str], most: int):
        self.sources, self.most = sources, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(pair) for pair in sorted(self.sources.items())]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        from urllib.request import urlopen

        source, address = partition.value
        for page in range(1, self.most + 1):
            with urlopen(address.replace("{page}", str(page)), timeout=30) as answer:
                body = answer.read().decode()
            yield source, page, body
            if not json.loads(body).get("has_more"):
                return


#: The kinds of boards, what each may be configured with, and how its bodies become rows.
BOARDS = {
    "csv": ({"model", "score"}, lambda b, c: plain_csv(b).select(F.col("path").alias("source"), F.col("record")[c["model"]].alias("model"), F.col("record")[c["score"]].try_cast("double").alias("score")).where("score is not null")),
    "paged_json": ({"most"}, lambda b, c: paged_json(b, c.get("most", PAGES)).select("source", "model", "score")),
    "harness_json": (set(), lambda b, c: harness_board(b).select("source", "model", "score")),
    "template_csv": ({"model", "score"}, lambda b, c: template_csv(b, c["model"], c["score"]).select("source", "model", "score")),
}


def board_rows(kind: str, config: dict, bodies: DataFrame) -> DataFrame:
    """source, model, score of boards of a kind in BOARDS. Another kind, or a key that the kind does
    not have, is refused before anything is read."""
    if kind not in BOARDS:
        raise ValueError(f"no board is of kind {kind}")
    keys, read = BOARDS[kind]
    if unknown := sorted(set(config) - keys):
        raise ValueError(f"{kind} has no key {', '.join(unknown)}")
    return read(bodies, config)


def scored(rows: DataFrame, model: Column, board: Column, score: Column, error: Column | None = None) -> DataFrame:
    """model, board, score, low, high: rows without a model or a numeric score are dropped; bounds
    are score -+ error where that is known."""
    value = score.try_cast("double")
    out = rows.select(model.alias("model"), board.alias("board"), value.alias("score"), *([error.try_cast("double").alias("_e")] if error is not None else [F.lit(None).cast("double").alias("_e")]))
    out = out.where(F.col("score").isNotNull() & (F.coalesce(F.trim("model"), F.lit("")) != ""))
    return out.select("model", "board", "score", (F.col("score") - F.col("_e")).alias("low"), (F.col("score") + F.col("_e")).alias("high"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with place: 1224 ranks within each board, the best score first."""
    return rows.withColumn("place", F.rank().over(Window.partitionBy("board").orderBy(F.col("score").desc())).cast("long"))


def category_means(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """model, score: the mean of category means, for models that have every task of every category.

    scores: model, task, score. categories: task, category. A model that lacks a task has no mean
    for that category, and one that lacks a category no score.
    """
    tasks = categories.select("task", "category").distinct()
    per = tasks.groupBy("category").agg(F.count("*").alias("_tasks"))
    n = per.agg(F.count("*").alias("_categories"))
    means = scores.where("score is not null").join(few(tasks), "task").groupBy("model", "category").agg(F.avg("score").alias("_m"), F.count_distinct("task").alias("_have"))
    full = means.join(F.broadcast(per), "category").where("_have = _tasks")
    out = full.groupBy("model").agg(F.avg("_m").alias("score"), F.count("*").alias("_have")).crossJoin(F.broadcast(n))
    return out.where("_have = _categories").select("model", "score")


def carried_share(rows: DataFrame, wanted: Column, least: float = 0.5) -> DataFrame:
    """The rows that are wanted, by board; none of a board where under `least` of them are."""
    share = F.avg(F.coalesce(wanted, F.lit(False)).cast("double")).over(Window.partitionBy("board"))
    return rows.withColumn("_share", share).where((F.col("_share") >= least) & wanted).drop("_share")


def template_csv(scripts: DataFrame, name: str, score: str) -> DataFrame:
    """source, model, score: rows of the CSV inside the first template literal of a script that
    begins with the column name. Columns are picked by their header; an asterisk before a name
    and rows without a number are dropped. scripts: source, body."""
    block = F.regexp_extract("body", rf"(?s)`\s*({name},[^`]+)`", 1)
    lines = scripts.select("source", F.split(F.trim(block), r"\r?\n").alias("lines")).where(F.size("lines") > 1)
    rows = lines.select("source", F.split(F.col("lines")[0], ",").alias("head"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    cell = lambda c: F.get(F.split("line", ","), (F.array_position("head", c) - 1).cast("int"))
    out = rows.where(F.array_contains("head", score)).select("source", F.trim(F.regexp_replace(cell(name), r"^\*", "")).alias("model"), cell(score).try_cast("double").alias("score"))
    return out.where((F.col("model") != "") & F.col("score").isNotNull())


def newest_edition(pointers: DataFrame, editions: DataFrame) -> DataFrame:
    """model, score, low, high, eligible: the rows of the edition that a pointer file names.

    pointers: body, as {"latest": id}. editions: id, body, as {"main_board": [rows]}. Models whose
    name ends in -contributor before the @ are no candidates.
    """
    wanted = pointers.select(F.get_json_object("body", "$.latest").alias("id"))
    board = F.from_json(F.get_json_object("body", "$.main_board"), "array<struct<model string, l2 struct<rate double, ci95 array<double>>>>")
    rows = editions.join(wanted, "id", "left_semi").select(F.inline(board))
    base = F.substring_index("model", "@", 1)
    return rows.select("model", F.col("l2.rate").alias("score"), F.get("l2.ci95", F.lit(0)).alias("low"), F.get("l2.ci95", F.lit(1)).alias("high"), (~base.rlike("(?i)-contributor$")).alias("eligible"))


def submissions(files: DataFrame) -> DataFrame:
    """model, score, low, high, eligible: one JSON file a submission, percent as fractions, bounds
    from half the width of the interval; all are for reference only. files: path, body."""
    of = lambda p: F.get_json_object("body", p)
    score, half = (of(p).try_cast("double") for p in ("$.metrics.accuracy", "$.metrics.accuracy_ci95_half_width"))
    out = files.select(F.substring_index(of("$.source_filter.model_name"), "/", -1).alias("model"), score.alias("s"), half.alias("h")).where("s is not null")
    return out.select("model", (F.col("s") / 100).alias("score"), ((F.col("s") - F.col("h")) / 100).alias("low"), ((F.col("s") + F.col("h")) / 100).alias("high"), F.lit(False).alias("eligible"))


def island_results(pages: DataFrame, component: str, view: str) -> DataFrame:
    """source, model, score: the overall results in the properties of a page's island component.

    Properties are JSON in an attribute, each value a pair of a kind and itself: 0 a plain value or
    an object, 1 an array, 11 an infinity. pages: source, html.
    """
    import html as entities
    import json
    import re

    def plain(value):
        if not (isinstance(value, list) and len(value) == 2 and isinstance(value[0], int)):
            return value
        kind, inner = value
        if kind == 1:
            return [plain(x) for x in inner]
        if kind == 11:
            return float("inf") * (1 if inner == 1 else -1)
        return {k: plain(x) for k, x in inner.items()} if isinstance(inner, dict) else inner

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, page in zip(b["source"], b["html"], strict=True):
                for tag in re.findall(r"<astro-island\b[^>]*>", page or ""):
                    props = re.search(r'\sprops="([^"]*)"', tag)
                    if props and re.search(rf'component-url="[^"]*{re.escape(component)}[^"]*"', tag):
                        overall = plain(json.loads(entities.unescape(props[1]))[view])["tasks"]["overall"]
                        out += [(source, model, r.get("accuracy")) for model, r in sorted(overall.items())]
                        break
            yield pd.DataFrame(out, columns=["source", "model", "score"])

    return pages.select("source", "html").mapInPandas(run, "source string, model string, score double")


#: Readers of boards by the form of their source: each takes tables of bodies and gives rows.
READERS = {"zip_csv": zipped_csv, "template_csv": template_csv, "edition": newest_edition, "submissions": submissions, "island": island_results}
