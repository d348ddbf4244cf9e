"""BM25, centrality and their sum.

Term counts for a query are taken within each row, so scoring shuffles nothing
but one row of statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.constants import B, K1, LAMBDA
from fernwalk.functions import text as T
from fernwalk.operators.sentences import gathered
from fernwalk.storage import stored

#: Scores are rounded so before they are compared, as sums of floats depend on their order; parts keep more places.
PART_PLACES, PLACES = 9, 6
#: Sentences of which a task tells the sums at a time.
SENTENCES = 20_000


def _bm25(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def bm25(rows: DataFrame, terms: list[str], keys: list[str], text: str = "s", k1: float = K1, b: float = B) -> DataFrame:
    """``keys`` and ``bm25`` of the rows that hold a term; each row of ``rows`` is a unit of the corpus."""
    terms = sorted({t.lower() for t in terms})
    times = lambda term: F.size(F.filter("hits", lambda x: x == term))
    tokens = rows.select(*keys, T.words(F.col(text)).alias("w"))
    # One pass over the words keeps the few that are asked for; the counts are taken from those.
    asked = tokens.select(*keys, F.size("w").alias("len"), F.filter("w", lambda x: x.isin(terms)).alias("hits"))
    # The few numbers of each row are read twice, for the statistics and for the scores.
    counted = stored(asked.select(*keys, "len", *(times(t).alias(f"tf{i}") for i, t in enumerate(terms))))
    stats = counted.agg(
        F.count_if(F.col("len") > 0).cast("double").alias("n"),
        F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("average"),
        *(F.sum((F.col(f"tf{i}") > 0).cast("long")).cast("double").alias(f"df{i}") for i in range(len(terms))),
    )
    total = F.lit(0.0)
    for i in range(len(terms)):
        part = _bm25(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("len"), F.col("average"), k1, b)
        total = total + F.when(F.col(f"tf{i}") > 0, part).otherwise(0.0)
    # A row holds a term exactly if its sum is above zero. Asked of the sum, the filter stays above the
    # join; below it, words would be matched again to answer it.
    scored = counted.crossJoin(F.broadcast(stats)).select(*keys, total.alias("bm25")).where("bm25 > 0")
    return scored.select(*keys, F.round("bm25", PART_PLACES).alias("bm25"))


def centrality(rows: DataFrame, method: str = "centroid") -> DataFrame:
    """``(doc_id, pos, centrality)``: cosine of each sentence and its whole document.

    The dot product is a sum over the sentence's words, so nothing is paired with
    anything. Sentences are shuffled once, by document; a document's words are counted
    where its sentences are, and nothing is sorted by word.
    """
    if method != "centroid":
        raise ValueError(f"no such method: {method}")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "pos")}
    sums = gathered(rows).mapInArrow(_sums, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, dot long, own long, doc long")
    # The parts are whole numbers, so they don't depend on any order.
    return sums.select("doc_id", "pos", F.round(F.col("dot") / (F.sqrt("own") * F.sqrt("doc")), PART_PLACES).alias("centrality"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each sentence with words its product with the whole document, and the squared lengths of both."""
    for batch in batches:
        ids = batch.column("doc_id")
        rows, out = [], ([], [], [], [])
        for k in range(batch.num_rows):
            each: dict[int, Counter] = {}
            for pos, words in zip(batch.column("pos")[k].as_py(), batch.column("words")[k].as_py(), strict=True):
                if words:
                    each.setdefault(pos, Counter()).update(words.split(" "))
            whole: Counter = Counter()
            for c in each.values():
                whole.update(c)
            doc = sum(n * n for n in whole.values())
            for pos, c in each.items():
                rows.append(k)
                for column, x in zip(out, (pos, sum(n * whole[w] for w, n in c.items()), sum(n * n for n in c.values()), doc), strict=True):
                    column.append(x)
            if len(rows) >= SENTENCES or k == batch.num_rows - 1:
                kinds = (batch.schema.field("pos").type.value_type, pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *map(pa.array, out, kinds)], names=["doc_id", "pos", "dot", "own", "doc"])
                rows, out = [], ([], [], [], [])


def combine(rows: DataFrame, bm25: DataFrame, centrality: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """``rows`` with ``score``: BM25 plus ``lam`` times centrality; what is missing counts as zero."""
    keys = ["doc_id", "pos"]
    score = F.coalesce("bm25", F.lit(0.0)) + lam * F.coalesce("centrality", F.lit(0.0))
    return rows.join(centrality, keys, "left").join(bm25, keys, "left").withColumn("score", F.round(score, PLACES)).drop("bm25", "centrality")
