"""Which sources a query asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwalk.constants import BASE_SOURCES, FLAG_SOURCES


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FLAG_SOURCES, "flag string, source string")


def resolve_sources(queries: DataFrame, table: DataFrame | None = None, base: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, source)``, each once, for ``queries(query_id, flags)``; ``base`` are asked for every query."""
    table = F.broadcast(catalog(queries.sparkSession)) if table is None else table
    asked = queries.select("query_id", F.explode("flags").alias("flag"))
    out = asked.join(table, "flag").select("query_id", "source")
    if base:
        out = out.union(queries.select("query_id", F.explode(F.array(*map(F.lit, base))).alias("source")))
    return out.distinct()


def all_sources() -> list[str]:
    return [*BASE_SOURCES, *dict.fromkeys(s for _, s in FLAG_SOURCES)]
