"""Sentences and words as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwalk.functions import text as T


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, pos, s)``: sentences that aren't blank, trimmed, by their place in the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.sentences(F.col(text_col))).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.trim("s").alias("s")).where("s <> ''")


def counted_words(words: Column) -> Column:
    """Each word of an array with how often it stands there: equal words are neighbours once they are sorted; the array isn't empty."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        count = lambda all_: F.transform(all_, lambda i, k: F.struct(F.get(w, i - 1).alias("term"), (F.coalesce(F.get(all_, k + 1), F.size(w) + 1) - i).cast("long").alias("tf")))
        return F.transform(F.array(starts), count)[0]

    # As elements of an array the sorted words and the starts are computed once.
    return F.transform(F.array(F.sort_array(words)), runs)[0]


def postings(rows: DataFrame) -> DataFrame:
    """``(doc_id, pos, term, tf)`` of ``rows(doc_id, pos, s)``.

    What is shuffled and grouped are sentences; their words are counted within the row,
    so no task keeps the words of many.
    """
    texts = rows.groupBy("doc_id", "pos").agg(F.collect_list("s").alias("all"))
    words = texts.select("doc_id", "pos", F.flatten(F.transform("all", T.words)).alias("w")).where("size(w) > 0")
    return words.select("doc_id", "pos", F.explode(counted_words(F.col("w"))).alias("x")).select("doc_id", "pos", "x.term", "x.tf")


def gathered(rows: DataFrame) -> DataFrame:
    """``(doc_id, pos, words)``, a row a document: the places of its sentences and, for each, its words with single spaces."""
    told = rows.select("doc_id", F.struct("pos", F.array_join(T.words(F.col("s")), " ").alias("words")).alias("x"))
    return told.groupBy("doc_id").agg(F.collect_list("x").alias("x")).select("doc_id", F.col("x.pos").alias("pos"), F.col("x.words").alias("words"))


def dedup_across_pages(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first of equal sentences, by ``order``; case and outer spaces don't count.

    ``order`` must decide between any two rows. Each task keeps its own first
    before the shuffle, so a sentence on every page costs one row a task.
    """
    first = Window.partitionBy(F.lower(F.trim("s"))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
