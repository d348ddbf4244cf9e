"""Running sums over a whole table in two levels, and a budget that all its rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwalk.storage import stored

#: Names of columns and whether they fall; together they must decide between any two rows.
Order = tuple[tuple[str, bool], ...]


def running_sum(rows: DataFrame, value: Column, order: Order, upto: float | None = None, name: str = "used") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value``, which is never negative, of a row and all before it.

    Rows are dealt by ranges of ``order``, and only the ranges' sums, a row each,
    are summed in one place; a row's own sum starts from that of the ranges before.
    With ``upto`` rows beyond it are left out, and ranges that lie beyond it as a
    whole aren't sorted. Nulls come last and count as zero.
    """
    by = [F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_last() for c, falls in order]
    counted = rows.withColumn("_v", F.coalesce(value, F.lit(0)))
    ranged = stored(counted.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy("_range").agg(F.sum("_v").alias("_s"))
    sums = stored(per_range.select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before")))
    if upto is not None:
        sums = sums.where(F.col("_before") <= upto)
    within = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A range is a task's rows, so there are no more of them than tasks.
    out = ranged.join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.sum("_v").over(within))
    return (out if upto is None else out.where(F.col(name) <= upto)).drop("_range", "_before", "_v")


def select_within_total(scored: DataFrame, budget: int, cost: Column | None = None, keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Rows of ``scored(doc_id, pos, s, score)`` taken by score over all documents until one doesn't fit, with ``used``.

    ``cost`` is what a sentence takes, by default its characters; ``keys`` tell rows apart.
    """
    order = (("score", True), *((k, False) for k in keys))
    return running_sum(scored, F.length("s") if cost is None else cost, order, budget)
