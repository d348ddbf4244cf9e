"""Sentences seen before, timings by window and sessions, over streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fernwalk.functions import text as T
from fernwalk.storage import shared_folder

#: The store that keeps the state of ``first_page_stream`` off the heap; with ``forget_ms`` a session that runs it must name it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def dedup_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """New sentences of a stream of documents.

    With ``ts`` a sentence is forgotten once the watermark has passed it by
    ``delay``, so the state is bounded; without, the state grows with the number
    of distinct sentences. Which of two equal sentences comes first is the order
    of arrival, not the order of pages.
    """
    keys = [F.col(id_col).alias("doc_id")] + ([F.col(ts).cast("timestamp").alias("ts")] if ts else [])
    if ts:
        docs = docs.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = docs.select(*keys, F.posexplode(T.sentences(F.col(text_col))).alias("pos", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    rows = rows.withColumn("norm", F.lower("s"))
    if ts:
        return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["norm"]).drop("norm")
    return rows.dropDuplicates(["norm"]).drop("norm")


def timing_stream(events: DataFrame, every: str = "1 day", delay: str = "1 hour", ts: str = "ts", phase: str = "event_type", elapsed: str = "value") -> DataFrame:
    """Count, mean and maximum by window and phase; a window is told once the watermark has passed it."""
    return (
        events.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", delay)
        .groupBy(F.window("_ts", every), F.col(phase).alias("phase"))
        .agg(F.count("*").alias("n"), F.avg(elapsed).alias("avg_ms"), F.max(elapsed).alias("max_ms"))
        .select(F.col("window.start").alias("start"), "phase", "n", "avg_ms", "max_ms")
    )


class _FirstPage(StatefulProcessor):
    """Keeps the least page and place of one sentence for a time, and tells each new one."""

    def __init__(self, schema: str, forget_ms: int):
        self.schema, self.forget_ms = schema, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", self.schema, self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        doc_id, pos, s = min((r.doc_id, r.pos, r.s) for r in rows)
        if self.first.exists():
            held = self.first.get()
            if (held[0], held[1]) <= (doc_id, pos):
                return
        self.first.update((doc_id, pos, s))
        yield Row(norm=key[0], doc_id=doc_id, pos=pos, s=s)

    def close(self) -> None:
        pass


def first_page_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forget_ms: int | None = None) -> DataFrame:
    """``(norm, doc_id, pos, s)``: of equal sentences the one of the first page and place, whatever the order of arrival.

    A sentence that comes later but belongs to an earlier page is told again and takes
    the place of what was told before for its ``norm``, so the stream is written in
    update mode (``run_once``). What is told last is what
    ``sentences.dedup_across_pages`` gives for all that arrived. The state is a row
    for each distinct sentence, asked and set by Spark's own aggregation; with
    ``forget_ms`` one that wasn't changed for so long is forgotten, for which each
    sentence costs calls between Python and the state store. Rows without an id are
    left out.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(T.sentences(F.col(text_col))).alias("pos", "s"))
    rows = rows.withColumn("s", F.trim("s")).where("s <> ''").withColumn("norm", F.lower("s"))
    if forget_ms is not None:
        state = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos int, s string"
        return rows.groupBy("norm").transformWithState(_FirstPage(state, forget_ms), f"norm string, {state}", "Update", "processingTime")
    # The time is that of the batch, so a least row of an earlier batch is known by it and isn't told again.
    firsts = rows.withColumn("at", F.current_timestamp()).groupBy("norm").agg(F.min(F.struct("doc_id", "pos", "s", "at")).alias("first"))
    return firsts.where(F.col("first.at") == F.current_timestamp()).select("norm", "first.doc_id", "first.pos", "first.s")


def standing(changes: DataFrame) -> DataFrame:
    """``(doc_id, pos, s)``: what ``run_once`` added and didn't drop."""
    times = F.sum(F.when(F.col("op") == "add", 1).otherwise(-1))
    # Grouped by norm too, rows stay where ``run_once`` has put them.
    return changes.groupBy("norm", "doc_id", "pos", "s").agg(times.alias("_n")).where("_n > 0").drop("norm", "_n")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """``(op, norm, doc_id, pos, s)``: all that is there now through ``first_page_stream``, as a table in ``folder``.

    What was told is added; all but the first page and place of a ``norm`` are dropped
    as well. What a run before has told isn't told again.
    """
    rows = f"{folder}/rows"
    # A stream without files has no batch, but a table without rows.
    none = stream.sparkSession.range(0, 0, 1, 1).select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in stream.schema))
    none.write.mode("ignore").parquet(f"{rows}/batch=none")
    # A batch that is done again after a failure replaces what it wrote.
    writer = stream.writeStream.foreachBatch(lambda told, batch: told.write.mode("overwrite").parquet(f"{rows}/batch={batch}"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    told = stream.sparkSession.read.schema(stream.schema).parquet(rows)
    rank = F.row_number().over(Window.partitionBy("norm").orderBy("doc_id", "pos"))
    ops = F.when(rank == 1, F.array(F.lit("add"))).otherwise(F.array(F.lit("add"), F.lit("drop")))
    return told.select(*stream.columns, ops.alias("ops")).select(F.explode("ops").alias("op"), *stream.columns)


def read_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """The files below ``path``, or the one file that it is, as a stream, ``files`` of them in each batch."""
    # Spark takes a path for a folder unless it is a pattern.
    path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", str(files))).parquet(path)


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour", ts: str = "ts", user: str = "user_id", phase: str = "event_type", elapsed: str = "value") -> DataFrame:
    """``(user, start, end, n, failures, total_ms, longest_ms)`` of each run of a user's events less than ``gap`` apart.

    Over a stream a session is told once the watermark, ``delay`` behind the latest
    event, has passed its end; events that come later still are dropped and counted
    in the progress of the query (``late_rows``). A table needs no ``delay``. Events
    without a time or user are in no session.
    """
    rows = events.select(F.col(ts).cast("timestamp").alias("_ts"), F.col(user).alias("user"), F.col(phase).alias("_phase"), F.col(elapsed).alias("_elapsed"))
    rows = rows.where("_ts IS NOT NULL AND user IS NOT NULL")
    if delay is not None:
        rows = rows.withWatermark("_ts", delay)
    return (
        rows.groupBy("user", F.session_window("_ts", gap).alias("_w"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("_phase") == "error").alias("failures"), F.round(F.sum("_elapsed"), 4).alias("total_ms"), F.max("_elapsed").alias("longest_ms"))
        .select("user", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "failures", "total_ms", "longest_ms")
    )


def late_rows(progress: list) -> int:
    """Rows that came behind the watermark and were dropped, over all the batches of a query."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in json.loads(p.json)["stateOperators"])


def replay(events: DataFrame, folder: str, slices: int, ts: str = "ts", lag: str = "0") -> int:
    """Writes ``events`` to ``folder`` as they would arrive, in ``slices`` files one after the other; returns the files.

    An event arrives ``lag`` seconds, an expression over its columns, after its
    time, so that events with a lag stand behind later ones.
    """
    arrival = events.withColumn("_arrival", F.unix_micros(F.col(ts).cast("timestamp")) + F.expr(lag).cast("long") * 1_000_000)
    first, last = arrival.agg(F.min("_arrival"), F.max("_arrival")).first()
    width = (last - first) // slices + 1 if first is not None else 1
    for i in range(slices if first is not None else 0):
        part = arrival.where((F.col("_arrival") >= first + i * width) & (F.col("_arrival") < first + (i + 1) * width))
        part.drop("_arrival").coalesce(1).write.mode("append").parquet(folder)
    return slices


def stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's rows and checkpoint."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
