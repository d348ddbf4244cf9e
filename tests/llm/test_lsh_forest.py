from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from fernwalk.llm import lsh_forest as L
from tests.llm.conftest import clash, rows

DOCS = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(texts):
    """``(doc_id, n_shingles, component_id, kept)`` by all pairs of rows with an id."""
    sets, root = [(i, shingles(t)) for i, t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]
    return sorted(((i, n, c, i is not None and i == c) for i, n, c in out), key=repr)


def made(n=120, family=150, seed=4):
    """Texts of their own, near copies of some, and a family whose members are alike through one text above all."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bdfgklmprt") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(3000)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(40, 300))) for _ in range(n)]

    def changed(text, times):
        words = text.split()
        for _ in range(times):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        return " ".join(words)

    near = [changed(t, max(1, round(len(t.split()) * r.choice((0.005, 0.015, 0.025, 0.05))))) for t in texts]
    base = " ".join(r.choices(vocabulary, k=200))
    crowd = [changed(base, r.randint(1, 6)) for _ in range(family)]
    # A passage that many texts share makes none of them alike.
    passage = " ".join(r.choices(vocabulary, k=60))
    sharing = [" ".join(r.choices(vocabulary, k=80)) + " " + passage for _ in range(80)]
    out = texts + near + [base, *crowd] + sharing
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [4, 5])
def test_components_are_those_of_all_pairs(spark, seed):
    texts = made(seed=seed)
    assert rows(L.near_duplicates(spark.createDataFrame(texts, DOCS).repartition(6))) == plain(texts)


def test_a_window_that_is_smaller_than_its_region(spark):
    """Regions far larger than the window: only what is nearest in each order is compared."""
    texts = made(n=10, family=300)
    got, want = rows(L.near_duplicates(spark.createDataFrame(texts, DOCS), near=4)), plain(texts)
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)
    assert all(g[2] >= w[2] for g, w in zip(got, want, strict=True))  # never joined wrongly


def test_sketches_estimate_similarity():
    r = np.random.default_rng(3)
    for share in (0.5, 0.85, 0.95):
        both = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
        cut = int(len(both) * (1 + share) / 2)
        a, b = np.unique(both[:cut]), np.unique(both[len(both) - cut :])
        x, y = (np.frombuffer(L.sketch(s), np.uint8) for s in (a, b))
        similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(((x == y).mean() - 1 / 256) / (1 - 1 / 256) - similar) < 0.1


def test_exactly_at_the_least_similarity(spark):
    """17 of 20 shingles in common link, 16 of 20 don't."""
    words = [f"w{i}" for i in range(22)]
    one = " ".join(words)
    for lost, linked in ((3, True), (4, False)):
        other = " ".join(words[: 22 - lost])
        got = {r.doc_id: r.component_id for r in L.near_duplicates(spark.createDataFrame([(1, one), (2, other)], DOCS)).collect()}
        assert (got[2] == 1) is linked


def test_odd_rows(spark, odd, none):
    got = L.near_duplicates(clash(odd))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows(got) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert L.near_duplicates(none).isEmpty()
    short = [(1, "One two"), (2, "one TWO"), (3, "one"), (4, "one\ttwo"), (5, "two one"), (6, " one ")]
    assert rows(L.near_duplicates(spark.createDataFrame(short, DOCS))) == plain(short)
