"""Words of texts that are written without spaces: the likeliest cut by a lexicon of the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from fernwalk.functions import text as T

#: Words of the lexicon, the most frequent ones, and the longest of them; both bound what a task holds.
LEXICON, LONGEST = 200_000, 32
#: A character outside the lexicon costs as much as this share of a word that was seen once.
UNKNOWN = 0.01
#: Characters that are looked at, and rows that are told, at a time.
CHARACTERS, ROWS = 1 << 15, 256
#: What stands between texts that are cut together; no word has it.
BETWEEN = "\0"


def lexicon(docs: DataFrame, text_col: str = "text", size: int = LEXICON) -> DataFrame:
    """``(word, n)``: the most frequent words of ``docs``; ties go by the word."""
    words = docs.select(F.explode(T.words(F.col(text_col))).alias("word")).where(F.length("word") <= LONGEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(size)


def costs(known: DataFrame) -> tuple[dict[str, float], float]:
    """The negative logarithm of each word's share, and what a character costs that no word explains."""
    counts = {r["word"]: r["n"] for r in known.collect()}
    total = sum(counts.values()) or 1
    return {w: math.log(total / n) for w, n in counts.items()}, math.log(total / UNKNOWN)


def branches(cost: dict[str, float]) -> dict:
    """The words as a trie of dicts; a word's cost stands under the empty text."""
    root: dict = {}
    for word, c in cost.items():
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = c
    return root


def cut_words(text: str, cost: dict[str, float], unknown: float, root: dict | None = None) -> list[str]:
    """The cut of the least cost; of equal ones the one whose last word is longest. Unknown characters stand alone.

    This is for a text or two; ``Cutter`` gives the same for many, in less time and memory.
    ``root`` is the trie of ``cost``; from each place only beginnings of words are followed.
    """
    root = branches(cost) if root is None else root
    best, back = [math.inf] * (len(text) + 1), [0] * (len(text) + 1)
    best[0] = 0.0
    for start in range(len(text)):
        here, node, end = best[start], root, start
        for ch in text[start : start + LONGEST]:
            node = node.get(ch)
            if node is None:
                break
            end += 1
            # Longer words reach an end before shorter ones do, so one of equal cost doesn't replace them.
            if "" in node and here + node[""] < best[end]:
                best[end], back[end] = here + node[""], start
        if here + unknown < best[start + 1] and text[start] not in cost:
            best[start + 1], back[start + 1] = here + unknown, start
    out, end = [], len(text)
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1]


class Cutter:
    """Cuts as ``cut_words`` does. The trie is a hash table in arrays, which a task holds in tens of MB, and is followed from many places at once."""

    def __init__(self, cost: dict[str, float], unknown: float) -> None:
        words = [w for w in cost if 0 < len(w) <= LONGEST]
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(w.ljust(LONGEST, BETWEEN) for w in words).encode("utf-32-le"), np.uint32).reshape(-1, LONGEST)
        at, node, keys, n = np.arange(len(words)), np.zeros(len(words), np.int64), [], 1
        for depth in range(LONGEST):
            longer = lengths[at] > depth
            at = at[longer]
            new, child = np.unique(node[at] << 21 | letters[at, depth], return_inverse=True)
            node[at] = n + child
            keys.append(new)
            n += len(new)
        self.unknown, self.cost = unknown, np.full(n, np.inf)
        self.cost[node] = [cost[w] for w in words]
        keys = np.concatenate(keys)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            # Of keys that want the same slot one has it.
            has = self.keys[slot[left]] == keys[left]
            self.nodes[slot[left[has]]] = left[has] + 1
            left = left[~has]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """The nodes that the keys lead to, 0 if there's none."""
        slot = self._slot(keys)
        stands = self.keys[slot]
        out = np.where(stands == keys, self.nodes[slot], 0)
        left = np.flatnonzero((stands != keys) & (stands >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            stands = self.keys[slot[left]]
            out[left] = np.where(stands == keys[left], self.nodes[slot[left]], 0)
            left = left[(stands != keys[left]) & (stands >= 0)]
        return out

    def _words(self, points: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, float]]:
        """``(start, end, cost)`` of the words, and the unknown characters, that begin at the places from ``a`` to ``b``, in order."""
        at = np.flatnonzero(points[a:b] != ord(BETWEEN)) + a
        node, found = np.zeros(len(at), np.int64), []
        for depth in range(LONGEST):
            inside = at + depth < len(points)
            at, node = at[inside], node[inside]
            told = self._children(node << 21 | points[at + depth])
            if not depth:
                unknown = at[~np.isfinite(self.cost[told])]
                found.append((unknown, unknown + 1, np.full(len(unknown), self.unknown)))
            at, node = at[told > 0], told[told > 0].astype(np.int64)
            if not len(at):
                break
            cost = self.cost[node]
            ends = np.isfinite(cost)
            found.append((at[ends], at[ends] + depth + 1, cost[ends]))
        start, end, cost = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort((start - a).astype(np.uint16), kind="stable")
        return zip(start[order].tolist(), end[order].tolist(), cost[order].tolist(), strict=True)

    def ends(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Where the words of each text end."""
        held, n = [], 0
        for text in texts:
            if held and n + len(text) > CHARACTERS:
                yield from self._ends(held)
                held, n = [], 0
            held.append(text)
            n += len(text) + 1
        if held:
            yield from self._ends(held)

    def _ends(self, texts: list[str]) -> Iterator[np.ndarray]:
        points = np.frombuffer((BETWEEN.join(texts) + BETWEEN).encode("utf-32-le"), np.uint32).astype(np.int64)
        best, back = [math.inf] * len(points), [0] * len(points)
        first = 0
        for text in texts:
            best[first] = 0.0
            first += len(text) + 1
        for a in range(0, len(points), CHARACTERS):
            for start, end, cost in self._words(points, a, min(a + CHARACTERS, len(points))):
                # Longer words reach an end before shorter ones do, so one of equal cost doesn't replace them.
                if (cost := cost + best[start]) < best[end]:
                    best[end], back[end] = cost, start
        first = 0
        for text in texts:
            out, end = [], first + len(text)
            while end > first:
                out.append(end - first)
                end = back[end]
            yield np.array(out[::-1], np.int32)
            first += len(text) + 1


@F.pandas_udf(ArrayType(IntegerType()))
def _sums(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda n: [] if n is None else np.cumsum(n, dtype=np.int32))


def ends(words: str) -> Column:
    """Where each of an array of words ends in the text that they make up."""
    return _sums(F.transform(words, F.length))


def cut_texts(texts: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with ``words``, cut out of each run of letters; null texts give none.

    The lexicon is bounded, so it goes to each task as it is.
    """
    shared = texts.sparkSession.sparkContext.broadcast(Cutter(*costs(known)))

    @F.arrow_udf("array<string>")
    def cut(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for runs in columns:
            told = [pa.array([], pa.list_(pa.string()))]
            for a in range(0, len(runs), ROWS):
                rows = [row or [] for row in runs[a : a + ROWS].to_pylist()]
                found = shared.value.ends(r for row in rows for r in row)
                spans = lambda r, ends: (r[x:y] for x, y in zip([0, *ends], ends, strict=False))
                told.append(pa.array([[w for r in row for w in spans(r, next(found).tolist())] for row in rows], pa.list_(pa.string())))
            yield pa.concat_arrays(told)

    return texts.withColumn("words", cut(T.words(F.col(text_col))))


def cut_again(texts: DataFrame, known: DataFrame, words_col: str) -> DataFrame:
    """``texts`` with, instead of ``words_col``, ``n_cut`` and ``n_same``: these words without spaces, cut again, and how many of the cut end where one of them does.

    A task holds the words of few texts, and of their cut only where they end.
    """
    shared = texts.sparkSession.sparkContext.broadcast(Cutter(*costs(known)))
    others = [f for f in texts.schema.fields if f.name != words_col]
    schema = StructType([*others, StructField("n_cut", IntegerType()), StructField("n_same", IntegerType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                some = batch.slice(a, ROWS)
                words = some.column(words_col)
                n_cut, n_same = np.zeros(len(some), np.int32), np.zeros(len(some), np.int32)
                for i, cut in enumerate(shared.value.ends(t or "" for t in pc.binary_join(words, "").to_pylist())):
                    own = pc.utf8_length(words[i].values).to_numpy() if len(cut) else cut
                    n_cut[i], n_same[i] = len(cut), len(np.intersect1d(np.cumsum(own), cut, assume_unique=True))
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in others), pa.array(n_cut), pa.array(n_same)], schema.names)

    return texts.mapInArrow(counted, schema)
