"""Benchmark decontamination: pigeonhole edit matching.

An item that may stand in a text with k edits is split into k + 1 pieces, one of
which must stand unchanged. An Aho-Corasick automaton finds the pieces of all
items; around each hit Myers' bit-parallel algorithm gives the edit distance.

The items never come to the driver: they are written as shards of bounded size to
the shared folder. A task gathers texts up to a bound and goes through the shards one
after the other, so that it holds one automaton at a time and reads its texts once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fernwalk.llm.common import SLICE, freed, map_columns, shared_folder

#: Edits allowed for each hundred characters of an item.
EDITS_PER_100 = 8
#: Items with fewer characters than this must stand unchanged and as whole words.
WHOLE_WORDS = 24
#: Characters of the items of a shard, and of the texts that a task holds while it goes through several shards.
BLOCK_CHARS, HELD_CHARS = 4_000_000, 16_000_000

_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower-cased words with single spaces."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def budget(item: str, per_100: int = EDITS_PER_100) -> int:
    return len(item) * per_100 // 100 if len(item) >= WHOLE_WORDS else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length and where each starts."""
    n = edits + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' algorithm for one item, which may begin and end anywhere in a text."""

    def __init__(self, item: str):
        self.item, self.masks = item, {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> int:
        """Least edit distance between the item and any part of ``text``."""
        m = len(self.item)
        full, last = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, least = full, 0, m, m
        get = self.masks.get
        for c in text:
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
                if score < least:
                    least = score
            ph = ph << 1 & full
            mh = mh << 1 & full
            plus = mh | (full & ~(xv | ph))
            minus = ph & xv
        return least


class Matcher:
    def __init__(self, items: list[tuple], per_100: int = EDITS_PER_100):
        self.items = []
        self.hits = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for key, item in items:
            edits = budget(item, per_100)
            for offset, piece in pieces(item, edits):
                at.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((key, Pattern(item), edits))
        for piece, places in at.items():
            self.hits.add_word(piece, (len(piece), places))
        if at:
            self.hits.make_automaton()

    def find(self, text: str | None) -> dict:
        """Items that stand in the text, and their distances."""
        return self.find_flat(normalise(text))

    def find_flat(self, flat: str) -> dict:
        """The same for a normalised text."""
        if not flat or not self.items:
            return {}
        found: dict = {}
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.hits.iter(flat):
            for item, offset in places:
                key, pattern, edits = self.items[item]
                start = end + 1 - length - offset
                if len(pattern.item) < WHOLE_WORDS:
                    if flat[start - 1 : start] in ("", " ") and flat[end + 1 : end + 2] in ("", " "):
                        found[key] = 0
                    continue
                windows.setdefault(item, []).append((max(0, start - edits), start + len(pattern.item) + edits))
        for item, spans in windows.items():
            key, pattern, edits = self.items[item]
            if found.get(key) == 0:
                continue
            if pattern.item in flat:
                found[key] = 0
                continue
            least = edits + 1
            for a, b in joined(spans):
                least = min(least, pattern.best(flat[a:b]))
            if least <= edits:
                found[key] = min(least, found.get(key, least))
        return found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> list[str]:
    """Names of files that every task can open, each with some of the items that hold a word.

    The files lie in the shared folder; Spark hands them to the executors, also to
    those that come later.
    """
    spark = benchmark.sparkSession
    start = lambda: lambda rows: {"id": rows["id"], "item": [normalise(t) for t in rows["item"]]}
    kind = benchmark.schema[id_col].dataType.simpleString()
    named = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("item"))
    items = map_columns(named, start, f"id {kind}, item string").where("item <> ''")
    chars = items.agg(F.sum(F.length("item"))).first()[0]
    if not chars:
        return []
    folder = f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}"
    items.repartition(-(-chars // block_chars)).write.parquet(folder)
    files = sorted(spark.read.parquet(folder).inputFiles())
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


@lru_cache(maxsize=1)
def load(shard: str, per_100: int) -> Matcher:
    """The matcher of a shard, in a task; a worker's next tasks use it again."""
    held = pq.read_table(SparkFiles.get(shard))
    return Matcher(list(dict.fromkeys(zip(held["id"].to_pylist(), held["item"].to_pylist(), strict=True))), per_100)


def search(names: list[str], texts: list[str | None], per_100: int) -> list[dict]:
    """What all shards' items find in each text: items and their least distances."""
    flat = [normalise(t) for t in texts]
    found: list[dict] = [{} for _ in texts]
    for name in names:
        matcher = load(name, per_100)
        for at, text in zip(found, flat, strict=True):
            for key, n in matcher.find_flat(text).items():
                at[key] = min(n, at.get(key, n))
    return found


def searched(df: DataFrame, names: list[str], at: int, per_100: int, schema, give: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch], held_chars: int = HELD_CHARS) -> DataFrame:
    """What ``give`` makes of slices of ``df`` and of what the shards find in their ``at``-th column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0

        def through() -> Iterator[pa.RecordBatch]:
            found = search(names, [t for part in held for t in part.column(at).to_pylist()], per_100)
            for part in held:
                yield give(part, found[: part.num_rows])
                del found[: part.num_rows]
            held.clear()

        for batch in freed(batches):
            for i in range(0, batch.num_rows, SLICE):
                held.append(batch.slice(i, SLICE))
                chars += pc.sum(pc.utf8_length(held[-1].column(at))).as_py() or 0
                # One shard stays in memory anyway; several are loaded for many texts at a time.
                if len(names) == 1 or chars > held_chars:
                    yield from through()
                    chars = 0
        if held:
            yield from through()

    return df.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    per_100: int = EDITS_PER_100,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    held_chars: int = HELD_CHARS,
) -> DataFrame:
    """``(doc_id, item_id, distance)`` for every document and item that stands in it within its budget of edits.

    Texts are compared in lower case, by their words. A null or empty text holds
    nothing, and an item without a word stands nowhere; one of fewer than
    WHOLE_WORDS characters must stand unchanged, as whole words. Where an item's id
    repeats, with the same text or others, the least distance is told once. Repeated
    rows of ``docs`` are each told; ids may be null. Very long texts are searched
    whole. Other columns are ignored, and an empty table on either side gives an
    empty result.
    """
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = T._parse_datatype_string(f"doc_id {doc_kind}, item_id {item_kind}, distance int")
    names = shards(benchmark, item_col, "text", block_chars)
    if not names:
        return docs.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)

    def give(part: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        items, distances = [k for f in found for k in f], [n for f in found for n in f.values()]
        return pa.RecordBatch.from_arrays([part.column(0).take(of).cast(arrow.field(0).type), pa.array(items, arrow.field(1).type), pa.array(distances, pa.int32())], schema=arrow)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return searched(rows, names, 1, per_100, schema, give, held_chars)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", per_100: int = EDITS_PER_100, block_chars: int = BLOCK_CHARS, held_chars: int = HELD_CHARS) -> DataFrame:
    """``docs`` without those in which an item stands; nothing of them is shuffled."""
    names = shards(benchmark, item_col, "text", block_chars)
    if not names:
        return docs
    give = lambda part, found: part.filter(pa.array([not f for f in found], pa.bool_()))
    return searched(docs, names, docs.columns.index(text_col), per_100, docs.schema, give, held_chars)
