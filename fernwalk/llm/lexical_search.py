"""Ranked lexical search over a clustered index whose documents are reordered by recursive graph bisection.

Bisection halves documents again and again, and swaps them between the halves as
long as that lowers the cost of writing down the gaps of the posting lists (Dhulipala
et al. 2016). It is fitted on a bounded sample; every document is then routed down the
tree of the sample's halves, to a leaf. A leaf is cut into shards of bounded size,
and within each shard all documents are bisected anew into clusters.

A shard keeps, for each term and cluster, the largest impact. A query adds these to a
bound for each cluster, visits clusters from the largest bound down, and stops where
the bound is below its k-th best score: what is left can't enter the answer. A first
round visits one cluster a shard, so that the second starts from a score that k
documents of the whole corpus have.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fernwalk.llm.common import checked_broadcast, map_columns, written

#: Bytes of digits, letters and all beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents of the sample that the tree is fitted on, the longest of them in words, and the tree's levels.
SAMPLE, SAMPLE_WORDS, LEVELS = 4096, 5000, 5
#: Documents of a shard and of a cluster, and the most swaps of a level.
SHARD, CLUSTER, ROUNDS = 2048, 128, 8
#: Answers to a query, and terms of queries that are asked at a time.
TOP, BLOCK_TERMS = 50, 500_000

INDEX = "shard long, term binary, df long, docs binary, tfs binary, clusters binary, bounds binary, ids array<{id}>, marks array<long>"


def terms_of(text: bytes | None) -> Counter:
    return Counter(TERM.findall((text or b"").lower()))


def impact(tf: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * mark)


# Recursive graph bisection.


def _degrees(docs, terms, part, side, parts, vocabulary):
    """Documents that hold a term, by half, part and term."""
    key = (side[docs] * parts + part[docs]) * vocabulary + terms
    return np.bincount(key, minlength=2 * parts * vocabulary)


def bisect(docs: np.ndarray, terms: np.ndarray, place: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """``place`` after one level: each part of ``width`` places has its halves settled.

    Posting i says that document ``docs[i]`` holds ``terms[i]``. All parts of the level are handled at once.
    A half of n documents, d of which hold a term, costs ``d * log2(n / (d + 1))`` for it.
    """
    n, vocabulary = len(place), int(terms.max()) + 1 if len(terms) else 1
    parts, half = -(-n // width), width // 2
    log = np.log2(np.maximum(np.arange(n + 3), 1))
    for _ in range(rounds):
        part, side = place // width, (place % width >= half).astype(np.int64)
        both = _degrees(docs, terms, part, side, parts, vocabulary)
        size = log[np.bincount(side * parts + part, minlength=2 * parts)]
        in_part, in_half = part[docs], side[docs]
        at = in_part * vocabulary + terms
        here, there = both[in_half * parts * vocabulary + at], both[(1 - in_half) * parts * vocabulary + at]
        size_here, size_there = size[in_half * parts + in_part], size[(1 - in_half) * parts + in_part]
        before = here * (size_here - log[here + 1]) + there * (size_there - log[there + 1])
        after = (here - 1) * (size_here - log[here]) + (there + 1) * (size_there - log[there + 2])
        gain = np.bincount(docs, weights=before - after, minlength=n)
        # The best of the left half trades places with the best of the right, the second with the second.
        group = part * 2 + side
        order = np.lexsort((np.arange(n), -gain, group))
        rank = np.arange(n) - np.searchsorted(group[order], group[order])
        ranked = np.full((2, parts, half), -1)
        ranked[side[order], part[order], rank] = order
        a, b = ranked[:, (ranked >= 0).all(0)]
        trade = gain[a] + gain[b] > 1e-9
        if not trade.any():
            break
        a, b = a[trade], b[trade]
        place = place.copy()
        place[a], place[b] = place[b], place[a]
    return place


def reorder(docs: np.ndarray, terms: np.ndarray, n: int, cluster: int = CLUSTER) -> np.ndarray:
    """The place of each of ``n`` documents; runs of ``cluster`` places are the clusters."""
    place, width = np.arange(n), cluster
    # A term of one document costs the same wherever that is.
    some = np.bincount(terms)[terms] > 1 if len(terms) else np.zeros(0, bool)
    docs, terms = docs[some], np.unique(terms[some], return_inverse=True)[1]
    while width < n:
        width *= 2
    while width > cluster:
        place = bisect(docs, terms, place, width)
        width //= 2
    return place


class Tree:
    """The halves of a sample, by which any document is routed: a weight for each node and known term."""

    def __init__(self, sample: list[Counter], levels: int = LEVELS):
        df = Counter(t for d in sample for t in d)
        self.known = {t: i for i, t in enumerate(sorted(t for t, n in df.items() if n > 1))}
        held = [[self.known[t] for t in d if t in self.known] for d in sample]
        docs = np.repeat(np.arange(len(held)), [len(h) for h in held])
        terms = np.array([t for h in held for t in h], np.int64)
        place, width = np.arange(len(held)), 1 << max(levels, (max(len(held), 1) - 1).bit_length())
        self.weights, self.middle = [], []
        for _ in range(levels):
            place = bisect(docs, terms, place, width) if len(held) else place
            parts = -(-len(held) // width) if held else 1
            part, side = place // width, (place % width >= width // 2).astype(np.int64)
            both = _degrees(docs, terms, part, side, parts, len(self.known) or 1).reshape(2, parts, -1)
            weight = np.log2((both[1] + 1) / (both[0] + 1)).astype(np.float32)
            of_doc = np.bincount(docs, weights=weight[part[docs], terms], minlength=len(held))
            self.weights.append(weight)
            self.middle.append(np.array([np.median(of_doc[part == p]) if (part == p).any() else 0.0 for p in range(parts)]))
            width //= 2

    def leaf(self, terms) -> int:
        known = [self.known[t] for t in terms if t in self.known]
        at = 0
        for weight, middle in zip(self.weights, self.middle, strict=True):
            if at >= len(weight):  # the sample was too small to have this part
                return at
            at = 2 * at + int(weight[at, known].sum() > middle[at])
        return at


# The index.


def _forward(docs: DataFrame, tree: Tree, id_col: str, text_col: str) -> DataFrame:
    """The terms of each document, with the leaf it belongs to and a number that tells rows apart."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def start():
        at = [(TaskContext.get().partitionId() if TaskContext.get() else 0) << 40]

        def work(rows):
            made = {c: [] for c in ("id", "seq", "n", "leaf", "terms", "tfs")}
            for i, text in zip(rows["id"], rows["text"], strict=True):
                counts = terms_of(text)
                if counts:
                    at[0] += 1
                    names = sorted(counts)
                    row = (i, at[0], sum(counts.values()), tree.leaf(names), b" ".join(names), np.array([counts[t] for t in names], np.uint32).tobytes())
                    for c, x in zip(made, row, strict=True):
                        made[c].append(x)
            return made

        return work

    return map_columns(rows, start, f"id {kind}, seq long, n long, leaf int, terms binary, tfs binary")


def _build(table: pa.Table, count: int, length: int, cluster: int, arrow: pa.Schema) -> pa.Table:
    """The rows of one shard's index."""
    rows = table.sort_by("seq").to_pydict()
    shard, n = rows["shard"][0], len(rows["n"])
    names: dict[bytes, int] = {}
    terms = np.array([names.setdefault(t, len(names)) for x in rows["terms"] for t in x.split(b" ")], np.int64)
    tfs = np.frombuffer(b"".join(rows["tfs"]), np.uint32).astype(np.int64)
    docs = np.repeat(np.arange(n), [len(x) // 4 for x in rows["tfs"]])
    place = reorder(docs, terms, n, cluster)
    marks = np.zeros(n, np.int64)
    marks[place] = [100 - 50 + (50 * x * count) // length for x in rows["n"]]
    ids = [None] * n
    for i, p in zip(rows["id"], place.tolist(), strict=True):
        ids[p] = i
    at = place[docs]
    order = np.lexsort((at, terms))
    terms, at, tfs = terms[order], at[order], tfs[order]
    most = impact(tfs, marks[at])
    of = at // cluster
    first = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(of) != 0)])
    bounds, of, runs = np.maximum.reduceat(most, first), of[first], terms[first]
    ends, cuts = np.searchsorted(terms, np.arange(len(names) + 1)), np.searchsorted(runs, np.arange(len(names) + 1))
    out = {f.name: [] for f in arrow}

    def put(*row):
        for c, x in zip(out, row, strict=True):
            out[c].append(x)

    put(shard, b"", n, None, None, None, None, ids, marks.tolist())
    at16, tf32, of16, most32 = at.astype(np.uint16), tfs.astype(np.uint32), of.astype(np.uint16), bounds.astype(np.uint32)
    for name, t in names.items():
        a, b, c, d = ends[t], ends[t + 1], cuts[t], cuts[t + 1]
        put(shard, name, int(b - a), at16[a:b].tobytes(), tf32[a:b].tobytes(), of16[c:d].tobytes(), most32[c:d].tobytes(), None, None)
    return pa.table(out, schema=arrow)


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql import types as T

    made = T._parse_datatype_string(schema)
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in made])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, cluster: int = CLUSTER, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """The index of all documents that hold a term, written to the shared folder, and their number.

    A row is a shard's postings of a term: documents as places in the shard, and
    the largest impact of each cluster. The row of a shard without a term has its documents.
    """
    few = docs.select(F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)).alias("h"))
    share = min(1.0, 2 * sample / max(docs.count(), 1))
    few = few.where((F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))) & (F.octet_length("text") <= SAMPLE_WORDS * 10)).orderBy("h", "text").limit(sample)
    tree = Tree([c for c in (terms_of(bytes(r[0])) for r in few.select("text").collect()) if c])
    forward = written(_forward(docs, tree, id_col, text_col))
    leaves = forward.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).orderBy("leaf").collect()
    count, length = sum(r["docs"] for r in leaves), sum(r["words"] for r in leaves)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = INDEX.format(id=kind)
    if not count:
        return docs.sparkSession.createDataFrame([], schema), 0
    # Shards of a leaf are as many as keep each below its size; a leaf of many rows has many. Rows are dealt in turn.
    first, cuts = 0, []
    for r in leaves:
        cuts.append((r["leaf"], -(-r["docs"] * 9 // (shard * 8)), first))
        first += cuts[-1][1]
    dealt = docs.sparkSession.createDataFrame(cuts, "leaf int, shards long, first long")
    rows = forward.join(F.broadcast(dealt), "leaf").select((F.col("first") + F.pmod(F.xxhash64("seq"), "shards")).alias("shard"), "id", "seq", "n", "terms", "tfs")
    arrow = _arrow(schema, docs.sparkSession)
    # As many tasks as shards, so that a task's rows don't grow with the corpus.
    built = rows.repartition(first, "shard").groupBy("shard").applyInArrow(lambda t: _build(t, count, length, cluster, arrow), schema)
    return written(built), count


# Search.


class Shard:
    """What the asked terms have in one shard."""

    def __init__(self, rows: dict, cluster: int):
        self.cluster = cluster
        whole = rows["term"].index(b"")
        self.ids, self.marks = rows["ids"][whole], np.array(rows["marks"][whole], np.int64)
        self.clusters = -(-len(self.ids) // cluster)
        self.at: dict[bytes, int] = {}
        self.docs, self.impacts, self.starts, bounds = [], [], [], []
        for i, term in enumerate(rows["term"]):
            if i == whole:
                continue
            self.at[term] = len(self.docs)
            docs = np.frombuffer(rows["docs"][i], np.uint16).astype(np.int64)
            self.docs.append(docs)
            self.impacts.append(impact(np.frombuffer(rows["tfs"][i], np.uint32).astype(np.int64), self.marks[docs]))
            self.starts.append(np.searchsorted(docs, np.arange(self.clusters + 1) * cluster))
            most = np.zeros(self.clusters, np.int64)
            most[np.frombuffer(rows["clusters"][i], np.uint16)] = np.frombuffer(rows["bounds"][i], np.uint32)
            bounds.append(most)
        self.bounds = np.array(bounds)

    def visit(self, asked: list[tuple[int, int]], cluster: int) -> np.ndarray:
        """The scores of a cluster's documents; ``asked`` has terms of the shard and their weights."""
        base = cluster * self.cluster
        score = np.zeros(min(self.cluster, len(self.ids) - base), np.int64)
        for t, w in asked:
            a, b = self.starts[t][cluster], self.starts[t][cluster + 1]
            if a < b:
                score[self.docs[t][a:b] - base] += w * self.impacts[t][a:b]
        return score

    def answer(self, terms: list[tuple[bytes, int]], k: int, least: int, seed: bool) -> tuple[list[int], list[int], int]:
        """Places and scores that may be among the best ``k``, none below ``least``, and the clusters visited.

        With ``seed`` only the cluster of the largest bound is visited.
        """
        asked = [(self.at[t], w) for t, w in terms if t in self.at]
        if not asked:
            return [], [], 0
        bound = (self.bounds[[t for t, _ in asked]] * np.array([w for _, w in asked])[:, None]).sum(0)
        places, scores, visited = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for c in np.argsort(-bound, kind="stable").tolist():
            if bound[c] < max(least, 1):
                break
            found = self.visit(asked, c)
            visited += 1
            some = np.flatnonzero(found >= max(least, 1))
            places, scores = np.concatenate([places, some + c * self.cluster]), np.concatenate([scores, found[some]])
            if len(scores) > k:
                # Documents that tie with the k-th stay: which of them are told is decided by their ids.
                least = max(least, int(np.partition(scores, -k)[-k]))
                stay = scores >= least
                places, scores = places[stay], scores[stay]
            elif len(scores) == k:
                least = max(least, int(scores.min()))
            if seed:
                break
        return places.tolist(), scores.tolist(), visited

    def best(self, places: list[int], scores: list[int], k: int) -> list[tuple]:
        """The first ``k`` by score, then id, as ``(id, score)``; null ids come last."""
        found = sorted(((-s, self.ids[p] is None, self.ids[p] if self.ids[p] is not None else 0, p) for p, s in zip(places, scores, strict=True)))
        return [(self.ids[p], -s) for s, _, _, p in found[:k]]


def _ask(asked: DataFrame, items: list[tuple[int, list[tuple[bytes, int]], int]], k: int, cluster: int, kind: str, seed: bool) -> DataFrame:
    """``(item, id, score)``: each shard's best of each item, or in the seeding round the scores alone."""
    schema = f"item long, id {kind}, score long"
    arrow = _arrow(schema, asked.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        out: tuple[list, list, list] = ([], [], [])
        if len(rows["term"]) > 1:
            shard = Shard(rows, cluster)
            for item, terms, least in items:
                places, scores, _ = shard.answer(terms, k, least, seed)
                found = [(None, s) for s in sorted(scores, reverse=True)[:k]] if seed else shard.best(places, scores, k)
                out[0].extend([item] * len(found))
                out[1].extend(f[0] for f in found)
                out[2].extend(f[1] for f in found)
        return pa.table(dict(zip(("item", "id", "score"), out, strict=True)), schema=arrow)

    return asked.groupBy("shard").applyInArrow(run, schema)


def search(index: DataFrame, count: int, queries: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text", cluster: int = CLUSTER, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each row of ``queries``; see ``rank_documents``."""
    spark, kind = index.sparkSession, index.schema["ids"].dataType.elementType.simpleString()
    item_kind = queries.schema[item_col].dataType.simpleString()
    named = queries.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))

    def start():
        at = [(TaskContext.get().partitionId() if TaskContext.get() else 0) << 40]

        def work(rows):
            made = {"item": [], "item_id": [], "terms": []}
            for i, text in zip(rows["item_id"], rows["text"], strict=True):
                at[0] += 1
                for c, x in zip(made, (at[0], i, sorted(terms_of(text))), strict=True):
                    made[c].append(x)
            return made

        return work

    items = written(map_columns(named, start, f"item long, item_id {item_kind}, terms array<binary>"))
    empty = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    terms = items.agg(F.sum(F.size("terms"))).first()[0]
    if not count or not terms:
        return empty
    blocks, out = -(-terms // block_terms), None
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        each = mine.select("item", F.explode("terms").alias("term"))
        vocabulary = each.select("term").distinct().union(spark.createDataFrame([(bytearray(),)], "term binary"))
        asked = written(index.join(checked_broadcast(vocabulary), "term"))
        df = asked.where("octet_length(term) > 0").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.ln((2.0 * F.lit(float(count)) + 2) / (2.0 * F.col("df") + 1)))
        weighed = each.join(checked_broadcast(df), "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", weight.cast("long").alias("w")))).alias("terms"))
        told = [(r["item"], [(bytes(t), w) for t, w in r["terms"]]) for r in weighed.collect()]
        seeds = _ask(asked, [(i, t, 0) for i, t in told], k, cluster, kind, True)
        kth = seeds.select("item", "score", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc())).alias("r")).where(F.col("r") == k)
        least = {r["item"]: r["score"] for r in kth.collect()}
        found = _ask(asked, [(i, t, least.get(i, 0)) for i, t in told], k, cluster, kind, False)
        ranked = found.select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
        out = ranked if out is None else out.union(ranked)
    return out.join(checked_broadcast(items.select("item", "item_id")), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each row of ``queries`` the ``k`` best of ``docs``.

    Null and empty texts hold no term: such a document is never told and not
    counted, such a query has no answer. Rows that repeat, on either side, are each
    told; equal scores are ranked by id, null ids last. Very long texts are indexed
    whole. Other columns are ignored, and an empty table on either side gives an empty result.
    """
    index, count = build_index(docs, id_col, text_col)
    return search(index, count, queries, k, item_col)
