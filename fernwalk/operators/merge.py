"""Results of several sources brought together, capped, and replaced where they are missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwalk.constants import PER_SOURCE, TOP_RESULTS


def merge_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def top_per_source(results: DataFrame, key: Column, tiebreak: Column, n: int = PER_SOURCE, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """The first ``n`` of each source by ``key``, with their place ``rk``; each task caps its own rows first."""
    best = Window.partitionBy(*by).orderBy(key, tiebreak)
    return results.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= n)


def top_results(results: DataFrame, key: Column, tiebreak: Column, n: int = TOP_RESULTS) -> DataFrame:
    return results.orderBy(key, tiebreak).limit(n)


def with_fallback(primary: DataFrame, secondary: DataFrame, on: str | None = "query_id") -> DataFrame:
    """``primary``, and ``secondary`` where it gave nothing: for each ``on``, or as a whole if that is None.

    Both sides are planned and may run; for a costly secondary ask
    ``primary.isEmpty()`` first.
    """
    if on is not None:
        return primary.unionByName(secondary.join(primary.select(on).distinct(), on, "left_anti"))
    some = primary.limit(1).agg((F.count("*") > 0).alias("_some"))
    missing = secondary.crossJoin(F.broadcast(some)).where("NOT _some").drop("_some")
    return primary.unionByName(missing)


def coalesce_fetch(primary: DataFrame, secondary: DataFrame, on: str = "url", columns: tuple[str, ...] = ("body",)) -> DataFrame:
    """``primary`` with those of ``columns`` that are null filled from ``secondary``, one row a key there."""
    other = secondary.select(on, *(F.col(c).alias(f"_{c}") for c in columns))
    out = primary.join(other, on, "left")
    return out.select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in primary.columns))


def prefer_open_access(results: DataFrame, url: str = "url", oa_url: str = "oa_url") -> DataFrame:
    """With the open-access address as the URL where there is one."""
    return results.withColumn(url, F.coalesce(oa_url, url))


def rank_fusion(*ranked: DataFrame, item: str, k: int = 60) -> DataFrame:
    """``(item, score)``: the sum of ``1 / (k + rk)`` over rankings ``(item, rk)``; an extension for several sources."""
    rows = reduce(DataFrame.unionByName, (r.select(item, "rk") for r in ranked))
    return rows.groupBy(item).agg(F.round(F.sum(1.0 / (k + F.col("rk"))), 9).alias("score"))
