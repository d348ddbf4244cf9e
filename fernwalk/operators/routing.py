"""How each URL is to be fetched, by its host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwalk.constants import DEFAULT_METHOD, EXACT_ROUTES, ROUTES
from fernwalk.functions.urls import host, within


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, m, d in EXACT_ROUTES) for d, m in ROUTES], "domain string, method string, exact boolean")


def route(df: DataFrame, table: tuple[tuple[str, str], ...] = ROUTES, exact: tuple[str, ...] = EXACT_ROUTES, url: str = "url") -> DataFrame:
    """``df`` with ``method``: that of the first entry whose domain holds the host, else plain HTTP.

    Entries in ``exact`` take their own host only, with or without ``www.``.
    """
    h = host(F.col(url))
    method = F.when(F.lit(False), F.lit(None).cast("string"))
    for domain, name in table:
        fits = h.isin(domain, f"www.{domain}") if domain in exact else within(h, [domain])
        method = method.when(F.coalesce(fits, F.lit(False)), name)
    return df.withColumn("method", method.otherwise(DEFAULT_METHOD))


def route_by_table(df: DataFrame, table: DataFrame, url: str = "url") -> DataFrame:
    """As ``route``, by exact host, with a table ``(host, method)`` whose hosts are distinct."""
    named = table.select(F.col("host").alias("_host"), F.col("method").alias("_method"))
    return (
        df.withColumn("_h", host(F.col(url)))
        .join(named, F.col("_h") == F.col("_host"), "left")
        .withColumn("method", F.coalesce("_method", F.lit(DEFAULT_METHOD)))
        .drop("_h", "_host", "_method")
    )
