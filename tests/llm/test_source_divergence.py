from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.llm import source_divergence as D
from tests.llm.conftest import clash

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000


def plain(rows, min_docs=3, told=200):
    """The contract with Python's own integers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
        docs[lang].update(words.keys())
        counts[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: (lambda n: {t: 1 + SCALE * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:told]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)}
    return out


def corpus(seed=4, n=120):
    r = random.Random(seed)
    words = ["".join(r.choices("abcäß", k=r.randint(1, 4))) for _ in range(50)] + ["Z", "zz", "東京", "東"]
    return [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None, "ü"]), " ".join(r.choices(words, k=r.randint(0, 30)))) for _ in range(n)] + [("fr", "alone", "one two"), ("xx", "a", None), ("xx", "b", "")]


def result(df, **more):
    return {tuple(r) for r in D.divergences(df, **more).collect()}


def test_rows_are_the_contracts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert result(df) == plain(rows)
    assert result(df, min_docs=1, told=3) == plain(rows, 1, 3)


def test_tries_that_are_emitted_early_merge(spark, monkeypatch):
    rows = corpus(5)
    names = sorted({b or "" for _, b, _ in rows})
    df = spark.createDataFrame([(a or "", b or "", (t or "").encode()) for a, b, t in rows], "lang string, source string, text binary").coalesce(2)
    told = lambda found: {(r.lang, bytes(r.term)): (r.docs, dict(zip(r.sources, r.counts, strict=True))) for r in found.collect()}
    whole = told(D.merge_tries(D.count_terms(df, names), len(names), 1))
    parts = D.count_terms(df.repartition(9), names, held=20)
    assert parts.count() > len(whole)
    merged = D.merge_tries(parts, len(names), 1, range_leaves=15)
    assert told(merged) == whole and merged.count() == len(whole)
    assert {k: v for k, v in whole.items() if v[0] >= 3} == told(D.merge_tries(parts, len(names), 3))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aÄäb東京", max_size=5), max_size=40))
def test_a_walk_is_in_utf8_order(words):
    trie = D.Trie()
    leaves = [trie.leaf(w.encode()) for w in words]
    walked = list(trie.walk())
    assert [t.decode() for t, _ in walked] == sorted(set(words))
    assert dict(walked) == dict(zip((w.encode() for w in words), leaves, strict=True))


def test_counters_that_are_summed_early(monkeypatch):
    monkeypatch.setattr(D, "WAITING", 3)
    counts = D.Counts(2)
    for i in range(20):
        counts.add([b"b", b"a"], np.array([1, 2]), np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([i, 1, 2]))
    (batch,) = counts.rows("x")
    assert batch.to_pydict() == {"lang": ["x", "x"], "term": [b"a", b"b"], "docs": [40, 20], "sources": [[0, 1], [0]], "counts": [[20, 40], [190]]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=5), st.integers(1, 10**15))
def test_shares_are_exact(counts, more):
    total = max(counts) + more
    assert D.shares(np.array(counts), total).tolist() == [1 + SCALE * (c + 1) // total for c in counts]


def test_very_long_terms(spark):
    rows = [("en", "a", "x" * 300_000)] * 3 + [("en", "b", "x" * 299_999 + "y z")] * 3
    assert result(spark.createDataFrame(rows, "lang string, source string, text string")) == plain(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert result(clash(odd)) == plain(rows)
    assert result(clash(odd), min_docs=1) == plain(rows, 1)
    assert D.divergences(none).isEmpty()
    assert D.divergences(none).columns == ["lang", "source", "part", "item", "value", "rank"]
