"""MinHash near-dedup by an LSH forest.

A document is the set of its distinct three-word shingles. Equal sets are one node.
A node has HASHES min-hashes of a byte each; tree t orders all nodes by these bytes,
begun at byte ``t * STEP`` and read around. In such an order the nodes that share the
longest prefixes are neighbours: where texts are sparse a short prefix makes them so,
where thousands are alike a long one does, so the depth of the forest follows the
region. Nodes that share their first DEPTH bytes with no other node of a tree leave it.

A task reads a run of one order and compares each node with the next NEAR nodes by all
their bytes, as long as they share DEPTH. What seems similar is confirmed by the full
sets. First each node is tried with its nearest over all trees, which joins most of a
group, then with its nearest in each tree, and at last with all that is near and in
another component by then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwalk.llm.common import checked_broadcast, cut, freed, map_columns, released, written
from fernwalk.llm.components import connected_components

#: Words of a shingle; documents link if 100 * intersection >= LEAST * union.
WORDS, LEAST = 3, 85
#: Min-hashes of a node, trees, bytes between the starts of two trees, and bytes that candidates share at least.
HASHES, TREES, STEP, DEPTH = 256, 32, 8, 4
#: Following nodes of an order that a node is compared with.
NEAR = 64
#: Candidates have this estimated similarity. At a true one of 0.85 the estimate, whose standard deviation is 0.022 there, is lower once in 15,000 times.
SEEMS = 0.765
#: Shingles that are hashed at a time, and words whose hashes a task remembers.
CHUNK, MEMORY = 1 << 9, 100_000

_ODD, _SHIFT = np.random.default_rng(13).integers(0, 1 << 64, (2, HASHES), np.uint64)
_ODD |= np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, by which all bits depend on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of shingles as sorted 64-bit hashes; it remembers the hashes of words."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, {}

    def set_of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # ASCII letters and spaces, as bytes are split
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
        return np.unique(out)


def sketch(items: np.ndarray) -> bytes:
    """A byte of each min-hash."""
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(items), CHUNK):
        np.minimum(least, (items[at : at + CHUNK, None] * _ODD + _SHIFT).min(0), out=least)
    return (_mixed(least) & np.uint64(255)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tag, n_shingles, node, sketch)``, one row for each row of ``docs``.

    ``node`` is a hash of 128 bits of the set, null if the set is empty; ``tag`` is a hash of the text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("binary").alias("text"))

    def start():
        shingler = Shingler()

        def work(rows):
            sets = [shingler.set_of(t) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "tag": rows["tag"],
                "n_shingles": [len(s) for s in sets],
                "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sketch": [sketch(s) if len(s) else None for s in sets],
            }

        return work

    return map_columns(rows, start, f"doc_id {kind}, tag long, n_shingles long, node binary, sketch binary")


def _members(nodes: DataFrame) -> DataFrame:
    """``(tree, prefix, node, ordered)`` of the nodes that share a prefix with another; ``ordered`` is the sketch as the tree reads it."""
    starts = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.lit(t * STEP % HASHES).alias("at")) for t in range(TREES))))
    keyed = nodes.select("node", "sketch", starts.alias("t")).select("node", "t.tree", F.expr(f"substring(sketch, t.at + 1, {DEPTH})").alias("prefix"))
    shared = keyed.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("tree", "prefix")
    members = cut(keyed.join(shared, ["tree", "prefix"]).select("tree", "prefix", "node"))
    around = F.concat(F.expr(f"substring(sketch, tree * {STEP} % {HASHES} + 1, {HASHES})"), F.expr(f"substring(sketch, 1, tree * {STEP} % {HASHES})"))
    return members.join(nodes.select("node", "sketch"), "node").select("tree", "prefix", "node", around.alias("ordered"))


def _neighbours(members: DataFrame, nearest: bool, near: int, seems: float) -> DataFrame:
    """``(a, b, ca, cb, seems)`` of nodes that are near in an order of ``members(tree, ordered, node, comp)`` and in different components.

    With ``nearest`` only the best for each node. Runs of an order are dealt by range,
    so a region of any size is many tasks' work.
    """

    def run(batches):
        # What stands at the end of a batch is compared with what comes next.
        held: dict[str, np.ndarray] | None = None
        for batch in freed(batches):
            n = batch.num_rows
            if not n:
                continue
            new = {
                "tree": batch.column("tree").to_numpy(),
                "bytes": np.frombuffer(b"".join(batch.column("ordered").to_pylist()), np.uint8).reshape(n, HASHES),
                "node": np.array(batch.column("node").to_pylist(), object),
                "comp": np.array(batch.column("comp").to_pylist(), object),
            }
            old = 0 if held is None else len(held["tree"])
            both = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
            size = old + n
            best, other = np.zeros(size), np.full(size, -1)
            pairs: list[tuple] = []
            same = np.ones(size, bool)
            for j in range(1, min(near, size - 1) + 1):
                # In an order, what doesn't share the prefix with the j-th doesn't with a later one.
                lo = np.flatnonzero(same[: size - j])
                hi = lo + j
                alike = (both["tree"][lo] == both["tree"][hi]) & (both["bytes"][lo, :DEPTH] == both["bytes"][hi, :DEPTH]).all(1)
                same[lo[~alike]] = False
                lo, hi = lo[alike & (hi >= old)], hi[alike & (hi >= old)]
                apart = both["comp"][lo] != both["comp"][hi]
                lo, hi = lo[apart], hi[apart]
                if not len(lo):
                    if not same[: size - j].any():
                        break
                    continue
                agree = (both["bytes"][lo] == both["bytes"][hi]).mean(1)
                score = (agree - 1 / 256) / (1 - 1 / 256)
                good = score >= seems
                lo, hi, score = lo[good], hi[good], score[good]
                if nearest:
                    for x, y in ((lo, hi), (hi, lo)):
                        more = score > best[x]
                        best[x[more]], other[x[more]] = score[more], y[more]
                else:
                    pairs.append((lo, hi, score))
            if nearest:
                some = np.flatnonzero(other >= 0)
                pairs = [(some, other[some], best[some])]
            for lo, hi, score in pairs:
                falls = both["node"][lo] > both["node"][hi]
                a, b = np.where(falls, hi, lo), np.where(falls, lo, hi)
                columns = [pa.array(both[c][i], pa.binary()) for c in ("node", "comp") for i in (a, b)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], names=["a", "b", "ca", "cb", "seems"])
            held = {k: v[max(0, size - near) :].copy() for k, v in both.items()}

    ordered = members.repartitionByRange("tree", "ordered", "node").sortWithinPartitions("tree", "ordered", "node")
    return ordered.select("tree", "ordered", "node", "comp").mapInArrow(run, "a binary, b binary, ca binary, cb binary, seems double")


def sets_of(docs: DataFrame, wanted: DataFrame, text_col: str, words: int = WORDS) -> DataFrame:
    """``(node, items)``: the sets of ``wanted(node, tag)``, computed again from a text with the hash ``tag``."""
    texts = docs.select(F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("binary").alias("text")).join(checked_broadcast(wanted), "tag")

    def start():
        shingler = Shingler(words)
        return lambda rows: {"node": rows["node"], "items": [shingler.set_of(t).view(np.int64) for t in rows["text"]]}

    # Rows that repeat a text give the same set, and one of them is kept in each task already.
    kind = wanted.schema["node"].dataType.simpleString()
    return map_columns(texts.select("node", "text"), start, f"node {kind}, items array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """Those of ``pairs(a, b, ..)`` whose full sets are similar enough."""
    of_a = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    of_b = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(of_a, "a").join(of_b, "b")
    return both.where(100 * common >= least * (F.size("x") + F.size("y") - common)).select(*pairs.columns)


def _labelled(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """``(a, b, ca, cb)``: the pairs whose ends are in different components."""
    a, b = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    both = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    return both.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps(node, comp)`` after those that ``links(ca, cb)`` connect are one; a node without links is its own component."""
    whole = written(connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("component").alias("into")))
    grown = comps.join(whole, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
    new = whole.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("into").alias("comp"))
    return written(grown.unionByName(new))


def node_components(docs: DataFrame, nodes: DataFrame, text_col: str = "text", near: int = NEAR, seems: float = SEEMS) -> DataFrame:
    """``(node, comp)`` of the nodes that link to another; ``nodes(node, sketch, tag)`` has one row a node."""
    spark = nodes.sparkSession
    members = written(_members(nodes))
    released(spark)
    alone = members.withColumn("comp", F.col("node"))
    nearest = written(_neighbours(alone, True, near, seems).groupBy("a", "b").agg(F.max("seems").alias("seems")))
    ends = nearest.select(F.col("a").alias("node"), "a", "b", "seems").union(nearest.select(F.col("b").alias("node"), "a", "b", "seems"))
    best = ends.groupBy("node").agg(F.max(F.struct("seems", "a", "b")).alias("x"))
    sets = written(sets_of(docs, best.select("node").join(nodes.select("node", "tag"), "node"), text_col))
    first = best.select("x.a", "x.b").distinct()
    links = written(confirmed(first, sets))
    released(spark)
    comps = written(connected_components(links).select("node", F.col("component").alias("comp")))
    released(spark)
    links = written(confirmed(_labelled(nearest, comps), sets))
    comps = _joined(comps, links)
    released(spark)
    # Regions that are one component by now have nothing left to compare.
    known = written(members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    mixed = known.groupBy("tree", "prefix").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tree", "prefix")
    left = known.join(mixed, ["tree", "prefix"], "left_semi")
    candidates = written(_neighbours(left, False, near, seems).select("a", "b", "ca", "cb").distinct())
    released(spark)
    late = candidates.select(F.col("a").alias("node")).union(candidates.select(F.col("b").alias("node"))).distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(written(sets_of(docs, late.join(nodes.select("node", "tag"), "node"), text_col)))
    links = written(confirmed(candidates, sets))
    released(spark)
    return _joined(comps, links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, seems: float = SEEMS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Null texts and texts without words have an empty set and link with nothing, so
    each is its own component. Rows of equal sets link. A row whose id is null gets
    the component of its set, null if no linked row has an id, and isn't kept. Rows
    that repeat an id each get a row; if an id's rows link to different groups, each
    row tells its own. Very long texts are taken whole, other columns are ignored,
    and an empty table gives an empty result.
    """
    signed = written(signatures(docs, id_col, text_col))
    nodes = written(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("sketch").alias("sketch"), F.min("tag").alias("tag"), F.min("doc_id").alias("least")))
    comps = node_components(docs, nodes.select("node", "sketch", "tag"), text_col, near, seems)
    of_node = nodes.select("node", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = of_node.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = of_node.select("node", "comp").join(least, "comp").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
