"""Mixing sources to target weights: hash-threshold histograms.

Words are summed by source and hash bucket. Where a source's budget ends within a
bucket, only that bucket is cut into finer ones, until it holds one hash value;
below that threshold documents are taken once more. Nothing is sorted by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwalk.llm.common import SPACE, checked_broadcast, cut

#: Weights of the sources, in order of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: A target stops at this many times the size of its source.
MOST = 3
#: Bits of the hash, and of one step of the histogram.
HASH_BITS, STEP = 60, 12


def measures(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The words of a text, and a hash of the id: the first 60 bits of its MD5."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return size, F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, h)`` of each row."""
    size, h = measures(id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), h.alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)``, one row a source.

    All sizes are shared by weight; a share stops at MOST times the source, and
    what is over is shared again. That is a water level: source i is full if the
    level that just fills it, in the order of MOST * size / weight, needs no more
    than there is.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    order = Window.orderBy((F.col("source_size") / F.col("w")), "r")
    everything = Window.partitionBy()
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    w = (
        per.withColumn("r", rank)
        .withColumn("w", weight)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("below", F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("above_w", F.sum("w").over(rest))
        .withColumn("full", MOST * F.col("source_size") * F.col("above_w") <= (F.col("total") - F.col("below")) * F.col("w"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("full"), MOST * F.col("source_size")).otherwise(0)).over(everything))
        .withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything))
    )
    level = F.col("left").cast("double") / F.col("open_w").cast("double") * F.col("w").cast("double")
    target = F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(F.round(level, 6))
    return w.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``copies``, how often each document is taken whole, and ``last``, the largest hash taken once more.

    Of the documents with the hash at the boundary, all are taken if that comes
    nearer to the target than none.
    """
    state = goals.withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = cut(state.withColumns({"prefix": F.lit(0).cast("long"), "under": F.lit(0).cast("long"), "last": F.lit(None).cast("long")}))
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        open_ = state.where("last IS NULL").select(F.col("source").alias("s"), "prefix")
        inside = sizes.join(
            checked_broadcast(open_),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + STEP) == F.col("prefix")),
        )
        counted = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        running = counted.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        joined = running.join(
            checked_broadcast(state.select(F.col("source").alias("s"), "under", "rest")), F.col("source").eqNullSafe(F.col("s"))
        )
        over = F.col("under") + F.col("upto") > F.col("rest")
        edge = joined.groupBy("source").agg(
            F.min(F.when(over, F.struct("bucket", "upto", "words", "lo", "hi"))).alias("e"), F.max("hi").alias("top")
        )
        low = F.col("under") + F.col("e.upto") - F.col("e.words")
        nearer = F.col("under") + F.col("e.upto") - F.col("rest") < F.col("rest") - low
        single = (
            F.when(F.col("e").isNull(), F.coalesce("top", F.lit(-1)))
            .when(F.col("e.lo") == F.col("e.hi"), F.when(nearer, F.col("e.hi")).otherwise(F.col("e.lo") - 1))
        )
        found = edge.select(F.col("source").alias("s"), "e", "top")
        state = cut(
            state.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("now", F.coalesce("last", single))
            .select(
                "source", "source_size", "target", "copies", "rest",
                F.when(F.col("last").isNull() & F.col("e").isNotNull(), F.col("e.bucket")).otherwise(F.col("prefix")).alias("prefix"),
                F.when(F.col("last").isNull() & F.col("e").isNotNull(), low).otherwise(F.col("under")).alias("under"),
                F.col("now").alias("last"),
            )
        )
        if state.where("last IS NULL").isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", "last")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row for each row of ``docs``.

    Null and empty texts have size 0. A null source is one of its own, the last.
    Rows that share an id share its hash, so they are taken or left together.
    Other columns are ignored, and an empty table gives an empty result.
    Very long texts are counted whole.
    """
    sizes = cut(sized(docs, id_col, text_col, source_col))
    limits = checked_broadcast(thresholds(sizes, cut(targets(sizes)))).withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("copies") + (F.col("h") <= F.col("last")).cast("long"))
    return sizes.join(limits, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken")
    )


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``, how often, and ``taken``, their words times that.

    The decision is made again in each row from its own hash and its source's
    threshold, so texts aren't shuffled. A document without words goes by its hash
    like any other, and its words are 0. Columns of the same names are replaced.
    """
    sizes = cut(sized(docs, id_col, text_col, source_col))
    limits = checked_broadcast(thresholds(sizes, cut(targets(sizes)))).select(F.struct("source", "copies", "last").alias("limit"))
    own = [c for c in docs.columns if c not in ("copies", "taken")]
    size, h = measures(id_col, text_col)
    hashed = docs.select(F.struct(*own).alias("row"), size.alias("size"), h.alias("h"))
    times = F.col("limit.copies") + (F.col("h") <= F.col("limit.last")).cast("long")
    return (
        hashed.join(limits, F.col(f"row.{source_col}").eqNullSafe(F.col("limit.source")))
        .select("row", times.alias("copies"), (times * F.col("size")).alias("taken"))
        .where("copies > 0")
        .select("row.*", "copies", "taken")
    )
