"""Source divergence audit: mergeable radix tries.

A task counts the terms of its texts in one byte trie for each language, whose
leaves hold a counter for each source. Tries that grow large are emitted, leaf by
leaf in UTF-8 order, and begun anew. Leaves are dealt by ranges of (lang, term), so
that all tries' parts below the same prefixes meet; a task merges them into one
trie, drops the terms that are too rare and writes the rest in UTF-8 order. A
second walk over these leaves sums the divergences of all pairs of sources, and
keeps each source's most telling terms, ties in the order of the walk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwalk.llm.common import SLICE, checked_broadcast, freed, written

#: Bytes of letters: A-Z, a-z and all beyond ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: A language keeps terms of at least so many of its documents; shares are counted in units of one in SCALE.
MIN_DOCS, SCALE = 3, 1_000_000_000
#: Ranks of the terms that are told.
TERMS_TOLD = 200
#: Leaves that a task's tries hold before they are emitted, and that a range is meant to hold.
HELD, RANGE_LEAVES = 250_000, 100_000
#: Counters that wait to be summed, leaves that the second walk takes at once, and cells of the matrix of pairs that it holds between them.
WAITING, CHUNK, CELLS = 1_000_000, 4096, 1 << 22

#: ``sources`` are numbers of the sorted names of all sources.
LEAVES = "lang string, term binary, docs long, sources array<int>, counts array<long>"
ARROW = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


class Node:
    """A node, the bytes that lead to it, and the number of its leaf, if a term ends here."""

    __slots__ = ("label", "children", "leaf")

    def __init__(self, label: bytes):
        self.label, self.children, self.leaf = label, None, -1


class Trie:
    """A byte radix trie, which numbers its leaves as they come."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def leaf(self, term: bytes) -> int:
        """The number of ``term``'s leaf, which is made if it is missing."""
        node, at, n = self.root, 0, len(term)
        while at < n:
            if node.children is None:
                node.children = {}
            below = node.children.get(term[at])
            if below is None:
                below = node.children[term[at]] = Node(term[at:])
                at = n
            elif term.startswith(below.label, at):
                at += len(below.label)
            else:
                same = 1
                while at + same < n and same < len(below.label) and term[at + same] == below.label[same]:
                    same += 1
                fork = node.children[term[at]] = Node(below.label[:same])
                fork.children = {below.label[same]: below}
                below.label = below.label[same:]
                below, at = fork, at + same
            node = below
        if node.leaf < 0:
            node.leaf, self.size = self.size, self.size + 1
        return node.leaf

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms and their leaves in the order of their bytes, which is that of UTF-8."""
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            path += node.label
            if node.leaf >= 0:
                yield path, node.leaf
            if node.children:
                stack.extend((path, node.children[c]) for c in sorted(node.children, reverse=True))


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and the sum of each one's values."""
    k, v = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0, np.int64)])
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(v, first) if len(k) else v


class Counts:
    """The trie of one language, and what its leaves count: documents, and occurrences by source."""

    def __init__(self, sources: int):
        self.trie, self.known, self.sources = Trie(), {}, max(sources, 1)
        self.docs: tuple[list, list] = ([], [])
        self.pairs: tuple[list, list] = ([], [])
        self.waiting = 0

    def add(self, terms: list[bytes], docs: np.ndarray, of: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
        """``docs`` documents of each of ``terms``; pair i says that term ``of[i]`` stands ``count[i]`` times in ``source[i]``."""
        known, leaf = self.known, self.trie.leaf
        leaves = np.empty(len(terms), np.int64)
        for i, t in enumerate(terms):
            at = known.get(t)
            if at is None:
                at = known[t] = leaf(t)
            leaves[i] = at
        for held, k, v in ((self.docs, leaves, docs), (self.pairs, leaves[of] * self.sources + source, count)):
            held[0].append(k)
            held[1].append(v)
        self.waiting += len(of)
        if self.waiting > WAITING:
            self.settle()

    def settle(self) -> None:
        self.docs, self.pairs = (tuple([x] for x in summed(*held)) for held in (self.docs, self.pairs))
        self.waiting = 0

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """All leaves, in UTF-8 order."""
        self.settle()
        walked = list(self.trie.walk())
        if not walked:
            return
        rank = np.empty(len(walked), np.int64)
        rank[[leaf for _, leaf in walked]] = np.arange(len(walked))
        docs = np.zeros(len(walked), np.int64)
        docs[rank[self.docs[0][0]]] = self.docs[1][0]
        leaf, source = np.divmod(self.pairs[0][0], self.sources)
        order = np.argsort(rank[leaf], kind="stable")
        at, source, count = rank[leaf][order], source[order], self.pairs[1][0][order]
        cuts = np.searchsorted(at, np.arange(len(walked) + 1)).astype(np.int32)
        for i in range(0, len(walked), CHUNK):
            j = min(i + CHUNK, len(walked))
            a, b = cuts[i], cuts[j]
            offsets = pa.array(cuts[i : j + 1] - a)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[a:b], kind)) for x, kind in ((source, pa.int32()), (count, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (j - i)), pa.array([t for t, _ in walked[i:j]], pa.binary()), pa.array(docs[i:j]), *lists], schema=ARROW)


def _count(texts: list[bytes], source: np.ndarray, into: Counts) -> None:
    """Adds the terms of ``texts``, of which the i-th is from ``source[i]``."""
    found = [TERM.findall(t.lower()) for t in texts]
    tokens = pa.array([w for ws in found for w in ws], pa.binary()).dictionary_encode()
    code, n = tokens.indices.to_numpy().astype(np.int64), len(texts)
    doc = np.repeat(np.arange(n), [len(ws) for ws in found])
    held, times = summed([code * n + doc], [np.ones(len(code), np.int64)])
    of, doc = np.divmod(held, n)
    terms = tokens.dictionary.to_pylist()
    into.add(terms, np.bincount(of, minlength=len(terms)), of, source[doc], times)


def count_terms(docs: DataFrame, names: list[str], held: int = HELD) -> DataFrame:
    """Leaves of each task's tries over ``docs(lang, source, text)``; a term may stand in several rows."""
    number = {s: i for i, s in enumerate(names)}

    def run(batches):
        of: dict[str, Counts] = {}
        for batch in freed(batches):
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pydict()
                source = np.array([number[s] for s in part["source"]], np.int64)
                langs = np.array(part["lang"], object)
                for lang in sorted(set(part["lang"])):
                    mine = np.flatnonzero(langs == lang)
                    _count([part["text"][i] for i in mine], source[mine], of.get(lang) or of.setdefault(lang, Counts(len(names))))
                if sum(c.trie.size for c in of.values()) > held:
                    for lang in sorted(of):
                        yield from of.pop(lang).rows(lang)
        for lang in sorted(of):
            yield from of.pop(lang).rows(lang)

    return docs.mapInArrow(run, LEAVES)


def merge_tries(leaves: DataFrame, sources: int, min_docs: int = MIN_DOCS, range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """One row for each term of at least ``min_docs`` documents of its language; each range in UTF-8 order."""

    def run(batches):
        table = pa.Table.from_batches(batches, ARROW)
        for lang in sorted(pc.unique(table["lang"]).to_pylist()):
            rows = table.filter(pc.equal(table["lang"], lang)).combine_chunks()
            terms = rows["term"].combine_chunks().dictionary_encode()
            code, docs = terms.indices.to_numpy().astype(np.int64), rows["docs"].to_numpy()
            total = summed([code], [docs])[1]
            # What is too rare is known by now; the others' tries are put together.
            stays = np.flatnonzero(total >= min_docs)
            place = np.full(len(total), -1)
            place[stays] = np.arange(len(stays))
            lists = rows["sources"].combine_chunks()
            of = place[np.repeat(code, lists.value_lengths().to_numpy())]
            source, count = lists.flatten().to_numpy().astype(np.int64), rows["counts"].combine_chunks().flatten().to_numpy()
            counts = Counts(sources)
            counts.add(terms.dictionary.take(pa.array(stays)).to_pylist(), total[stays], of[of >= 0], source[of >= 0], count[of >= 0])
            yield from counts.rows(lang)

    ranges = max(leaves.sparkSession.sparkContext.defaultParallelism, -(-leaves.count() // range_leaves))
    return leaves.repartitionByRange(ranges, "lang", "term").mapInArrow(run, LEAVES)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + SCALE * (counts + 1) // total`` without a product beyond 64 bits, for totals under 9 * 10**15."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, np.shape(total)), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Audit:
    """Sums over the leaves of one language: of all pairs of its sources, and each source's best terms."""

    def __init__(self, sources: list[str], numbers: list[int], totals: list[int], kept: int):
        self.sources, self.at = sources, np.full(max(numbers) + 1, -1)
        self.at[numbers] = np.arange(len(numbers))
        self.totals = np.array(totals, np.int64) + kept
        self.whole = sum(totals) + kept
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.best = [(np.zeros(0, np.int64), []) for _ in sources]

    def add(self, terms: list[bytes], of: np.ndarray, source: np.ndarray, count: np.ndarray, told: int = TERMS_TOLD) -> None:
        """``terms`` in the order of the walk; pair i says that term ``of[i]`` stands ``count[i]`` times in the source of a number."""
        c = np.zeros((len(terms), len(self.sources)), np.int64)
        c[of, self.at[source]] = count
        p, some = shares(c, self.totals), c > 0
        q = shares(c.sum(1), self.whole)
        none = shares(np.zeros(len(self.sources), np.int64), self.totals)
        # Terms that neither source of a pair has all have one value; the others are few.
        some_i = some.astype(np.int64)
        either = some_i.sum(0)[:, None] + some_i.sum(0) - some_i.T @ some_i
        self.pairs += (len(terms) - either) * divergence(none[:, None], none)
        for s in range(len(self.sources)):
            mine = np.flatnonzero(some[:, s])
            self.pairs[s] += divergence(p[mine, s][:, None], p[mine]).sum(0)
            self.pairs[:, s] += np.where(some[mine], 0, divergence(none, p[mine, s][:, None])).sum(0)
            more = mine[p[mine, s] > q[mine]]
            old, names = self.best[s]
            values = np.concatenate([old, divergence(p[more, s], q[more])])
            first = np.argsort(-values, kind="stable")[:told]  # equal values stay in the order of the walk
            names = names + [terms[i] for i in more]
            self.best[s] = values[first], [names[i] for i in first]

    def pair_rows(self, lang: str) -> Iterator[tuple]:
        for i, a in enumerate(self.sources):
            for j, b in enumerate(self.sources):
                if i != j and self.pairs[i, j]:
                    yield lang, a, "pair", b, int(self.pairs[i, j])
        self.pairs[:] = 0

    def term_rows(self, lang: str) -> Iterator[tuple]:
        for source, (values, names) in zip(self.sources, self.best, strict=True):
            yield from ((lang, source, "term", t.decode("utf-8", "replace"), int(v)) for v, t in zip(values, names, strict=True))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, sources and counts of a batch's pairs."""
    lists = batch.column("sources")
    of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    return of, lists.flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy()


def _totals(merged: DataFrame) -> DataFrame:
    """``(lang, source, n)``: occurrences of kept terms by language and source number; under -1 the number of a language's terms."""

    def run(batches):
        keys: list[tuple[str, int, int]] = []
        for batch in freed(batches):
            langs = batch.column("lang").dictionary_encode()
            lang, names = langs.indices.to_numpy().astype(np.int64), langs.dictionary.to_pylist()
            of, source, count = _flat(batch)
            most = int(source.max(initial=0)) + 2
            k, v = summed([lang[of] * most + source + 1, lang * most], [count, np.ones(len(lang), np.int64)])
            keys += [(names[x // most], x % most - 1, y) for x, y in zip(k.tolist(), v.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64())], names=["lang", "source", "n"])

    return merged.select("lang", "sources", "counts").mapInArrow(run, "lang string, source int, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))


def _walk(merged: DataFrame, audits: dict[str, tuple[list[str], list[int], list[int], int]], told: int) -> DataFrame:
    """Partial sums of the pairs and each task's own best terms."""

    def run(batches):
        held: dict[str, Audit] = {}

        def batch_of(rows):
            rows = list(rows)
            names = ("lang", "source", "part", "item", "value")
            kinds = (*(pa.string(),) * 4, pa.int64())
            for i in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + (1 << 16)]], kind) for k, kind in enumerate(kinds)], names=list(names))

        for batch in freed(batches):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                mine = batch.filter(pc.equal(batch.column("lang"), lang))
                audit = held.get(lang) or held.setdefault(lang, Audit(*audits[lang]))
                # A matrix of chunk and sources is held at a time; with many sources the chunk is smaller.
                step = min(CHUNK, max(1, CELLS // max(len(audit.sources), 1)))
                for at in range(0, mine.num_rows, step):
                    some = mine.slice(at, step)
                    audit.add(some.column("term").to_pylist(), *_flat(some), told)
                if audit.pairs.size > CELLS:
                    yield from batch_of(audit.pair_rows(lang))
        for lang, audit in held.items():
            yield from batch_of(audit.pair_rows(lang))
            yield from batch_of(audit.term_rows(lang))

    return merged.select("lang", "term", "sources", "counts").mapInArrow(run, "lang string, source string, part string, item string, value long")


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, told: int = TERMS_TOLD) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of all groups ``(lang, source)`` of ``docs``.

    A language keeps the terms of ``min_docs`` of its documents. A group gives each of
    them ``p = 1 + SCALE * (count + 1) // (N + V)``, N its count of all kept terms, V
    their number. Part ``pair`` has each other source of the language, with the sum of
    ``(p - q) ** 2 // q`` over all kept terms, q that source's; part ``term`` the first
    ``told`` of the terms that stand in the group and have p above the language's own q.

    Null texts, languages and sources are read as empty. A group without terms has
    count 0 of each kept term; a language without kept terms gives its pairs the
    value 0 and no terms. Repeated rows are documents of their own, other columns are
    ignored, very long texts are counted whole, equal values are ranked by the UTF-8
    of the item, and an empty table gives an empty result. The number of groups, of
    which the result has all pairs of a language, is what comes to the driver.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    groups = written(docs.select(*filled).distinct())
    found = groups.collect()
    names = sorted({r["source"] for r in found})
    number = {s: i for i, s in enumerate(names)}
    merged = written(merge_tries(written(count_terms(docs.select(*filled, text), names)), len(names), min_docs))
    totals = {(r["lang"], r["source"]): r["n"] for r in _totals(merged).collect()}
    audits: dict[str, tuple[list[str], list[int], list[int], int]] = {}
    for lang, source in sorted(tuple(r) for r in found):
        of = audits.setdefault(lang, ([], [], [], totals.get((lang, -1), 0)))
        for column, value in zip(of, (source, number[source], totals.get((lang, number[source]), 0)), strict=False):
            column.append(value)
    walked = written(_walk(merged, audits, told))
    both = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    sums = walked.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = both.join(checked_broadcast(sums), ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).alias("rank")
    ranked_pairs = pairs.select("*", rank)
    ranked_terms = walked.where("part = 'term'").select("*", rank).where(F.col("rank") <= told)
    return ranked_pairs.unionByName(ranked_terms)
