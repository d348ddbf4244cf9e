"""The session and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that any session of the engine wants; cluster sizes are the deployment's.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS and ``settings`` (dots written as two underscores)."""
    builder = SparkSession.builder.appName("fernwalk")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, as stored; nothing is inferred from its rows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
