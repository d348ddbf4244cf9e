"""What the operators share: tables, the shared folder, checked broadcasts and Arrow row mapping."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contract, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"
#: Rows that one Python step holds at a time; a batch of any size is cut to this.
SLICE = 256
#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Only a session on one machine that
    has none gets a temporary folder; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fernwalk-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, for plans that join what comes from one checkpoint several times."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, as a driver with much memory rarely looks for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which must be cheap to count, with a broadcast hint if it has at most ``rows`` rows.

    Beyond that Spark joins it by shuffling both sides, and AQE splits the hot keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow holds of those before is given back each time, as workers live for many stages."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def map_columns(
    df: DataFrame,
    start: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: T.StructType | str,
) -> DataFrame:
    """Each slice of rows, as a dict of column lists, through the function that ``start()`` makes once a task."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in freed(batches):
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def filter_rows(df: DataFrame, column: str, start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``df`` that the function made by ``start()`` keeps, judged by one column; nothing is shuffled.

    All columns pass through untouched, whatever their names.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in freed(batches):
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield part.filter(pa.array(work(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def rewrite_text(df: DataFrame, column: str, start: Callable[[], Callable[[list], list[str | None]]]) -> DataFrame:
    """``df`` with one text column replaced by what the function made by ``start()`` returns for it."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in freed(batches):
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                arrays = list(part.columns)
                arrays[at] = pa.array(work(part.column(at).to_pylist()), part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return df.mapInArrow(run, df.schema)
