"""The best sentences of each document within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_sentences(scored: DataFrame, n: int, score: str = "score") -> DataFrame:
    best = Window.partitionBy("doc_id").orderBy(F.col(score).desc(), "pos")
    return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= n)


def select_within_budget(scored: DataFrame, budget: int, strategy: str = "prefix", cost: Column | None = None) -> DataFrame:
    """Rows of ``scored(doc_id, pos, s, score)`` taken by score until the budget is spent.

    ``prefix`` stops at the first sentence that doesn't fit, ``skip`` goes on with
    the next. ``cost`` is what a sentence takes, by default its characters.
    """
    cost = F.length("s") if cost is None else cost
    if strategy == "prefix":
        by_score = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "pos")
        spent = F.sum(cost).over(by_score.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return scored.withColumn("used", spent).where(F.col("used") <= budget)
    if strategy != "skip":
        raise ValueError(f"no such strategy: {strategy}")
    # Whether a sentence fits depends on all before it, so each document's small rows are folded in order.
    held = scored.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "pos", cost.cast("long").alias("n")))).alias("ranked")
    )
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))
    fold = F.aggregate(
        "ranked",
        start,
        lambda acc, x: F.when(
            acc["used"] + x["n"] <= budget,
            F.struct((acc["used"] + x["n"]).alias("used"), F.array_append(acc["taken"], x["pos"]).alias("taken")),
        ).otherwise(acc),
    )
    taken = held.select("doc_id", F.explode(fold["taken"]).alias("pos"))
    return scored.join(taken, ["doc_id", "pos"], "left_semi")
