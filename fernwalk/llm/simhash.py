"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits. Bit i carries
a nonzero vector m(i) of RADIUS + 1 bits; table v keeps the bits whose m(i) has an
odd number of ones in common with v. Two differing bits leave at least one v that
drops both, so every pair within the radius collides in some table.

Within a bucket, pairs aren't listed: each member stands under its own value and
under those that differ in one dropped bit. Members meet there exactly if they
differ in two bits or fewer, and at most 65 fingerprints can meet in one place.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.llm.common import checked_broadcast, cut, map_columns
from fernwalk.llm.components import connected_components

BITS, RADIUS, SEED, WORDS = 64, 2, 42, 3
#: Shingles of a text that are hashed at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """A bit is 1 if over half of the hashes of the word shingles have it; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        if len(words) < WORDS:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(words[at + k : min(at + CHUNK, n) + k] for k in range(WORDS)), strict=True))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row for each row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def start():
        return lambda rows: {"doc_id": rows[id_col], "fp": [fingerprint(t) for t in rows[text_col]]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(id_col, text_col), start, f"doc_id {kind}, fp long")


def masks() -> dict[int, int]:
    """The bits that each table keeps."""
    top = 1 << (RADIUS + 1)
    vector = [1 + i % (top - 1) for i in range(BITS)]
    return {v: sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, top)}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(reps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the ``rep`` of distinct fingerprints; they connect what is linked, and nothing else.

    ``reps(fp, rep)`` has one row for each fingerprint.
    """
    kept = masks()
    keyed = reps.select(
        "fp",
        "rep",
        F.explode(
            F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in kept.items()))
        ).alias("t"),
    ).select("fp", "rep", "t.v", "t.key")
    one = F.struct("fp", "rep")
    buckets = cut(
        keyed.groupBy("v", "key").agg(F.count("*").alias("n"), F.min(one).alias("lo"), F.max(one).alias("hi")).where("n > 1")
    )
    pairs = buckets.where(f"n = 2 AND bit_count(lo.fp ^ hi.fp) <= {RADIUS}").select(F.col("lo.rep").alias("a"), F.col("hi.rep").alias("b"))

    def meeting(v: Column) -> Column:
        """The values that a member of table v stands under."""
        out = None
        for t, m in kept.items():
            flips = F.array(F.lit(0), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1)).cast("array<bigint>")
            out = F.when(v == t, flips) if out is None else out.when(v == t, flips)
        return out

    large = checked_broadcast(buckets.where("n > 2").select("v", "key"))
    members = keyed.join(large, ["v", "key"]).select("fp", "rep", "v")
    met = (
        members.select("fp", "rep", F.explode(meeting(F.col("v"))).alias("flip"))
        .select(F.expr("fp ^ flip").alias("at"), "rep")
        .groupBy("at")
        .agg(F.collect_set("rep").alias("reps"))
        .where("size(reps) > 1")
        .select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
    )
    return pairs.union(met).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Rows that
    repeat an id or a text are linked through their fingerprint. A row whose id is
    null gets the component of its fingerprint, null if no row with an id has that
    fingerprint; such a fingerprint links nothing. Other columns are ignored, and
    an empty table gives an empty result.
    Very long texts are taken whole, a part of their shingles at a time.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = connected_components(links(reps.where("rep IS NOT NULL")))
    named = reps.join(comp, reps.rep == comp.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(named, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
