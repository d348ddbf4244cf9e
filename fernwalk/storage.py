"""Tables that a plan writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has no more rows than this.
SMALL_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on one machine, where it may be unset, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fernwalk-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read again from the shared folder."""
    folder = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, which must be cheap to count, with a broadcast hint if it is as small as that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
