from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.llm import lexical_search as X
from tests.llm.conftest import clash

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    """The contract, document by document."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scores = []
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in set(terms(text))}
        for at, (i, w) in enumerate(held):
            m = 100 - 50 + (50 * len(w) * n) // length
            score = sum(weights[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in weights)
            if score > 0:
                scores.append((-score, i is None, i or 0, at))
        out += [(item, r, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n=400, seed=1):
    r = random.Random(seed)
    topics = [["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(60)] for _ in range(5)]
    text = lambda: " ".join(r.choices(r.choice(topics) + topics[0][:10], k=r.randint(1, 80)))
    docs = [(i, text()) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)]  # ties beyond the last rank
    return docs, [(i, text()[: r.randint(5, 90)]) for i in range(25)] + [(90, docs[7][1])]


@pytest.mark.parametrize("shard, cluster, block_terms", [(4096, 128, 500_000), (32, 8, 60)])
def test_answers_are_those_of_all_documents(spark, shard, cluster, block_terms):
    docs, items = corpus()
    index, count = X.build_index(spark.createDataFrame(docs, "doc_id long, text string"), shard=shard, cluster=cluster, sample=64)
    got = X.search(index, count, spark.createDataFrame(items, "item_id long, text string"), 50, cluster=cluster, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, items)
    # Every document with a term is in one shard, and no shard is much larger than meant.
    ids = [r.ids for r in index.where("octet_length(term) = 0").collect()]
    assert sorted(i for x in ids for i in x) == sorted(i for i, _ in docs)
    assert len(ids) >= len(docs) / shard and max(map(len, ids)) <= 2 * shard


def test_clusters_are_left_out_by_their_bounds():
    """Two topics in one shard: a query of one doesn't visit the clusters of the other."""
    r = random.Random(2)
    words = [[f"{t}{i}" for i in range(30)] for t in "ab"]
    rows = [r.sample(words[i % 2], 12) for i in range(256)]
    names = {w: i for i, w in enumerate(sorted({w for x in rows for w in x}))}
    docs = np.repeat(np.arange(256), 12)
    place = X.reorder(docs, np.array([names[w] for x in rows for w in x]), 256, 32)
    assert sorted(place.tolist()) == list(range(256))
    halves = [sum(place[i] < 128 for i in range(t, 256, 2)) for t in (0, 1)]
    assert sorted(halves) == [0, 128]  # bisection puts the topics apart, though they alternate in the input
    table = {"term": [b""], "ids": [list(range(256))], "marks": [[100] * 256], "docs": [None], "tfs": [None], "clusters": [None], "bounds": [None]}
    for w, t in names.items():
        held = np.array(sorted(place[i] for i, x in enumerate(rows) if w in x))
        of = np.unique(held // 32)
        for c, x in zip(("docs", "tfs", "clusters", "bounds"), (held.astype(np.uint16), np.ones(len(held), np.uint32), of.astype(np.uint16), np.full(len(of), X.impact(1, 100), np.uint32)), strict=True):
            table[c].append(x.tobytes())
        table["term"].append(w.encode())
        table["ids"].append(None)
        table["marks"].append(None)
    shard = X.Shard(table, 32)
    places, scores, visited = shard.answer([(b"a1", 900), (b"a2", 800), (b"a3", 700)], 5, 0, False)
    assert visited <= 4 and len(scores) >= 5
    assert shard.answer([(b"a1", 900)], 5, 0, True)[2] == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=6, unique=True), min_size=1, max_size=40), st.sampled_from([1, 2, 8]))
def test_orders_are_permutations(rows, cluster):
    docs, found = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.array([t for x in rows for t in x])
    assert sorted(X.reorder(docs, found, len(rows), cluster).tolist()) == list(range(len(rows)))


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "THE same text"), (1, "lorem"), (2, None), (3, "..."), (None, "ünïcödé"), (4, "nowhere to be found")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    got = X.rank_documents(clash(odd), clash(items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, asked)
    assert X.rank_documents(none, items).isEmpty() and X.rank_documents(odd, items.where("false")).isEmpty()
