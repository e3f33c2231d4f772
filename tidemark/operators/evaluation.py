"""Confusion matrices, threshold sweeps, label queues and benchmark comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support of each class, from gold, predicted, n."""
    hit = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0))
    a = matrix.groupBy(F.col("gold").alias("class")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    b = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("named"))
    m = a.join(b, "class", "full").fillna(0)
    p, r = ratio(F.col("tp"), F.col("named")), ratio(F.col("tp"), F.col("support"))
    return m.select("class", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1(p, r), 3).alias("f1"), "support")


def sweep(rows: DataFrame, score: Column, gold: Column, thresholds: list[int]) -> DataFrame:
    """threshold, tp, fp, fn, tn, precision, recall, f1: one pass, counts by threshold."""
    ts = rows.select(score.alias("_s"), gold.alias("_g"), F.explode(F.lit(thresholds)).alias("threshold"))
    said = F.coalesce(F.col("_s") >= F.col("threshold"), F.lit(False))
    c = ts.groupBy("threshold").agg(*[F.count_if(cond).alias(n) for n, cond in (("tp", said & F.col("_g")), ("fp", said & ~F.col("_g")), ("fn", ~said & F.col("_g")), ("tn", ~said & ~F.col("_g")))])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1(p, r), 3).alias("f1"))


def label_queue(rows: DataFrame, labelled: DataFrame, near: float = 5, per_kind: int = 10) -> DataFrame:
    """id, queue: of the rows that have no label, up to per_kind each of promotions, blocked ones and
    scores near their threshold, in the order of md5(id). rows: id, score, threshold, promotion, relevance."""
    close = F.abs(F.col("score") - F.col("threshold")) <= near
    queue = F.when(F.col("promotion"), "promotion").when(F.col("relevance") == "block", "blocked").when((F.col("relevance") == "pass") & close, "near_threshold")
    found = rows.join(labelled, "id", "left_anti").withColumn("queue", queue).where("queue is not null")
    nth = F.row_number().over(Window.partitionBy("queue").orderBy(F.md5(F.col("id").cast("string"))))
    return found.withColumn("_n", nth).where(F.col("_n") <= per_kind).select("id", "queue")


def role_sample(candidates: DataFrame, roles: list[str], n: int) -> DataFrame:
    """id: items added until each role has its target, borderline scores first.

    The greedy fill needs only the first items of each role in order, role count times target of
    them at most, which one task folds. candidates: id, score, threshold, roles, picked.
    """
    import pandas as pd

    target = max(3, n // 10)
    border = F.coalesce(F.abs(F.col("score") - F.col("threshold")) <= 8, F.lit(False))
    rows = candidates.withColumn("_b", border).withColumn("_s", F.coalesce("score", F.lit(-1.0)))
    counts = rows.where("picked").select(F.explode("roles").alias("role")).groupBy("role").count()
    have = {r["role"]: r["count"] for r in counts.collect() if r["role"] in roles}
    order = [F.col("_b").desc(), F.col("_s").desc(), F.col("id")]
    by_role = rows.where("not picked").withColumn("role", F.explode("roles")).where(F.col("role").isin(roles))
    nth = F.row_number().over(Window.partitionBy("role").orderBy(*order))
    heads = by_role.withColumn("_n", nth).where(F.col("_n") <= target * len(roles)).select("id", "roles", "_b", "_s").dropDuplicates(["id"])

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        items = g.sort_values(["_b", "_s", "id"], ascending=[False, False, True]).to_dict("records")
        counted, added = {r: have.get(r, 0) for r in roles}, []
        for role in roles:
            for c in items:
                if counted[role] >= target:
                    break
                if c["id"] in added or role not in c["roles"]:
                    continue
                added.append(c["id"])
                for r in c["roles"]:
                    if r in counted:
                        counted[r] += 1
        return pd.DataFrame({"id": added})

    return heads.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(fold, f"id {candidates.schema['id'].dataType.simpleString()}")


def bench_compare(results: DataFrame, models: list[str]) -> DataFrame:
    """case, a column a model with its outcome, and disagree. results: case, model, outcome."""
    wide = results.groupBy("case").pivot("model", models).agg(F.first("outcome"))
    seen = F.array_compact(F.array(*[F.col(m) for m in models]))
    return wide.withColumn("disagree", F.size(F.array_distinct(seen)) > 1)
