"""Centrality of sentences on the graph of their similarities (Erkan and Radev 2004).

Sentences of a document are linked where the cosine of their weighted words reaches
a threshold. Weights come from counts over all documents, which Spark joins by word. All
else is within a document: its sentences are the rows of a matrix whose products, a
block of sentences with another at a time, are the cosines of all pairs, so that no
pairs are written or shuffled but the links. A damped walk on the links gives the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwalk.operators.rank import PART_PLACES
from fernwalk.operators.sentences import gathered
from fernwalk.storage import stored

#: Least similarity of a link, the share of a rank that links pass on, and the steps of the walk.
SIMILAR, DAMPING, STEPS = 0.3, 0.85, 24
#: Steps of the walk in one plan.
STEPS_A_PLAN = 6
#: Sentences of a block, and links that a task tells at a time.
BLOCK, TOLD = 256, 50_000
#: Links of a document that is walked in one task; documents with more are walked by joins.
WALKED = 500_000


def _weighted(rows: DataFrame) -> DataFrame:
    """``(doc_id, pos, words, terms, idf)``: the words of each document's sentences, and the distinct ones with their weight by rarity."""
    docs = stored(gathered(rows).where("doc_id IS NOT NULL"))
    terms = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform("words", lambda w: F.split(w, " "))))).alias("term")).where("term <> ''")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    documents = docs.where(F.exists("words", lambda w: w != "")).agg(F.count("*").cast("double").alias("n"))
    weight = terms.join(df, "term").crossJoin(F.broadcast(documents)).select("doc_id", F.struct("term", F.ln(1 + F.col("n") / F.col("df")).alias("idf")).alias("x"))
    weights = weight.groupBy("doc_id").agg(F.collect_list("x").alias("x")).select("doc_id", F.col("x.term").alias("terms"), F.col("x.idf").alias("idf"))
    return docs.join(weights, "doc_id")


def _vectors(pos: list[int], words: list[str], terms: list[str], idf: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Places in order, and as triples of row, column and value their vectors of length 1; words of one sentence alone have no column."""
    number = dict(zip(terms, range(len(terms)), strict=True))
    places, which = np.unique(pos, return_inverse=True)
    row, term = [], []
    for r, w in zip(which.tolist(), words, strict=True):
        if w:
            found = [number[x] for x in w.split(" ")]
            row += [r] * len(found)
            term += found
    keys, tf = np.unique(np.array(row, np.int64) * len(terms) + np.array(term, np.int64), return_counts=True)
    r, t = keys // len(terms), keys % len(terms)
    w = tf * np.array(idf)[t]
    w /= np.sqrt(np.bincount(r, w * w, len(places)))[r]
    often = np.bincount(t, minlength=len(terms)) > 1
    column = np.cumsum(often) - 1
    kept = often[t]
    return places, r[kept], column[t[kept]], w[kept], int(often.sum())


def _near(pos: list[int], words: list[str], terms: list[str], idf: list[float], similar: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(a, b, cosine)`` of the pairs of one document that may be links, a pair of blocks at a time."""
    places, r, t, w, width = _vectors(pos, words, terms, idf)

    def block(first: int) -> np.ndarray:
        at, end = np.searchsorted(r, (first, first + BLOCK))
        dense = np.zeros((min(BLOCK, len(places) - first), width))
        dense[r[at:end] - first, t[at:end]] = w[at:end]
        return dense

    for i in range(0, len(places), BLOCK):
        one = block(i)
        for j in range(i, len(places), BLOCK):
            cosine = one @ (one if i == j else block(j)).T
            a, b = np.nonzero(cosine >= similar - 1e-8)
            c = cosine[a, b]
            upper = a + i < b + j
            yield places[a[upper] + i], places[b[upper] + j], c[upper]


def links(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(doc_id, a, b, cosine)`` with ``a < b`` of the sentences of a document whose cosine is ``similar`` or more."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "pos")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("pos").type.value_type
            held: list = []

            def told() -> pa.RecordBatch:
                k, a, b, c = (np.concatenate([h[i] for h in held]) for i in range(4))
                held.clear()
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(k)), pa.array(a).cast(kind), pa.array(b).cast(kind), pa.array(c)], names=["doc_id", "a", "b", "cosine"])  # noqa: B023

            for k in range(batch.num_rows):
                for a, b, c in _near(*(batch.column(x)[k].as_py() for x in ("pos", "words", "terms", "idf")), similar):
                    held.append((np.full(len(a), k), a, b, c))
                    if sum(len(h[0]) for h in held[-BLOCK:]) >= TOLD or len(held) >= BLOCK:
                        yield told()
            if held:
                yield told()

    found = _weighted(rows).mapInArrow(run, f"doc_id {kinds['doc_id']}, a {kinds['pos']}, b {kinds['pos']}, cosine double")
    return found.withColumn("cosine", F.round("cosine", PART_PLACES)).where(F.col("cosine") >= similar)


def lexrank(rows: DataFrame, similar: float = SIMILAR, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """``(doc_id, pos, lexrank)`` of ``rows(doc_id, pos, s)``; the ranks of a document sum to 1.

    A sentence is similar to itself by 1, so one without links keeps its rank. The
    walk takes ``steps`` steps from equal ranks; what is left to change is below
    ``damping ** steps``. A document is walked in one task, or by joins if it has more
    than WALKED links or repeats a place.
    """
    rows = stored(rows.select("doc_id", "pos", "s"))
    near = stored(links(rows, similar))
    pos = rows.schema["pos"].dataType.simpleString()
    many = near.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > WALKED).select("doc_id")
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("m")).where("n > m").select("doc_id")
    apart = stored(many.union(twice).distinct())
    crowded = not apart.isEmpty()
    of = lambda x, how: x.join(apart, x["doc_id"].eqNullSafe(apart["doc_id"]), how) if crowded else x
    nodes = of(rows, "left_anti").groupBy("doc_id").agg(F.collect_list("pos").alias("pos"))
    edges = of(near, "left_anti").groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "cosine")).alias("x"))
    told = nodes.join(edges, "doc_id", "left").select("doc_id", "pos", *(F.col(f"x.{c}").alias(c) for c in ("a", "b", "cosine")))
    ranks = _walked(told, pos, damping, steps)
    return ranks if not crowded else ranks.union(_walked_by_joins(of(rows, "left_semi"), of(near, "left_semi"), damping, steps))


def _walked(docs: DataFrame, pos: str, damping: float, steps: int) -> DataFrame:
    """Ranks of ``docs(doc_id, pos, a, b, cosine)``, a row a document; places are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list = []
            for k in range(batch.num_rows):
                a, b, cosine = (np.array(batch.column(c)[k].as_py() or [], np.float64 if c == "cosine" else np.int64) for c in ("a", "b", "cosine"))
                places = np.sort(np.array(batch.column("pos")[k].as_py(), np.int64))
                n = len(places)
                a, b = np.searchsorted(places, a), np.searchsorted(places, b)
                src, dst = np.concatenate([a, b]), np.concatenate([b, a])
                share = np.concatenate([cosine, cosine])
                share = share / (1 + np.bincount(src, share, n))[src]
                # What a sentence keeps of its own rank, and what it passes on, sum to 1.
                own, p = 1 - np.bincount(src, share, n), np.full(n, 1 / n)
                for _ in range(steps):
                    p = (1 - damping) / n + damping * (own * p + np.bincount(dst, p[src] * share, n))
                held.append((np.full(n, k), places, p))
                if k == batch.num_rows - 1 or sum(len(h[0]) for h in held[-BLOCK:]) >= TOLD or len(held) >= BLOCK:
                    whose, at, ranks = (np.concatenate([h[i] for h in held]) for i in range(3))
                    held = []
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(whose)), pa.array(at).cast(batch.schema.field("pos").type.value_type), pa.array(ranks)], names=["doc_id", "pos", "p"])

    ranks = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos {pos}, p double")
    return ranks.select("doc_id", "pos", F.round("p", PART_PLACES).alias("lexrank"))


def _walked_by_joins(rows: DataFrame, near: DataFrame, damping: float, steps: int) -> DataFrame:
    nodes = rows.select("doc_id", "pos").withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    both = near.select("doc_id", F.col("a").alias("src"), F.col("b").alias("dst"), "cosine").union(near.select("doc_id", F.col("b").alias("src"), F.col("a").alias("dst"), "cosine"))
    whole = F.sum("cosine").over(Window.partitionBy("doc_id", "src"))
    edges = stored(both.withColumn("share", F.col("cosine") / (1 + whole)).drop("cosine"))
    # What a sentence keeps of its own rank, and what it passes on, sum to 1.
    kept = edges.groupBy("doc_id", F.col("src").alias("pos")).agg((1 - F.sum("share")).alias("own"))
    state = stored(nodes.join(kept, ["doc_id", "pos"], "left").select("doc_id", "pos", "n", F.coalesce("own", F.lit(1.0)).alias("own"), (1.0 / F.col("n")).alias("p")))
    for step in range(steps):
        sent = edges.join(state.select("doc_id", F.col("pos").alias("src"), "p"), ["doc_id", "src"])
        got = sent.groupBy("doc_id", F.col("dst").alias("pos")).agg(F.sum(F.col("p") * F.col("share")).alias("got"))
        moved = (1 - damping) / F.col("n") + damping * (F.col("own") * F.col("p") + F.coalesce("got", F.lit(0.0)))
        state = state.join(got, ["doc_id", "pos"], "left").select("doc_id", "pos", "n", "own", moved.alias("p"))
        if step % STEPS_A_PLAN == STEPS_A_PLAN - 1:
            state = stored(state)
    return state.select("doc_id", "pos", F.round("p", PART_PLACES).alias("lexrank"))
