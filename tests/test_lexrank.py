"""Links and ranks of sentences against all pairs and a dense walk."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from fernwalk.operators import lexrank as L
from fernwalk.operators import sentences as S

WORD = re.compile(r"[^\W\d_]+")


def documents(seed=5):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdef", k=r.randint(2, 4))) for _ in range(60)]
    one = lambda: " ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(1, 9)))
    return {d: ". ".join(one() for _ in range(r.randint(1, 25))) for d in range(12)} | {90: None, 91: "", 92: "12 34. 56", 93: "same one. same one. same one"}


def plain(texts):
    """Links and, by a walk until nothing moves, ranks."""
    sents = {d: [s.strip() for s in re.split(r"[.!?]+\s+|\n+", t) if s.strip()] for d, t in texts.items() if t}
    held = {d: set(w for s in ss for w in WORD.findall(s.lower())) for d, ss in sents.items()}
    n, df = sum(bool(h) for h in held.values()), Counter(w for h in held.values() for w in h)
    links, ranks = {}, {}
    for d, ss in sents.items():
        vectors = []
        for s in ss:
            v = {w: c * math.log(1 + n / df[w]) for w, c in Counter(WORD.findall(s.lower())).items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            vectors.append({w: x / size for w, x in v.items()})
        m = np.eye(len(ss))
        for a in range(len(ss)):
            for b in range(a + 1, len(ss)):
                cos = round(sum(x * vectors[b].get(w, 0.0) for w, x in vectors[a].items()), 9)
                if cos >= L.SIMILAR:
                    links[d, a, b] = cos
                    m[a, b] = m[b, a] = cos
        m /= m.sum(1, keepdims=True)
        p = np.full(len(ss), 1 / len(ss))
        for _ in range(L.STEPS):
            p = (1 - L.DAMPING) / len(ss) + L.DAMPING * p @ m
        ranks |= {(d, i): x for i, x in enumerate(p)}
    return links, ranks


def test_links_and_ranks_are_those_of_all_pairs(spark):
    texts = documents()
    rows = S.sentences(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    links, ranks = plain(texts)
    got = {(r.doc_id, r.a, r.b): r.cosine for r in L.links(rows).collect()}
    assert set(got) == set(links) and len(links) > 50
    assert max(abs(got[k] - links[k]) for k in links) < 1e-6
    walked = {(r.doc_id, r.pos): r.lexrank for r in L.lexrank(rows).collect()}
    assert set(walked) == set(ranks)
    assert max(abs(walked[k] - ranks[k]) for k in ranks) < 1e-6


def test_a_word_of_all_sentences_proposes_no_pairs(spark):
    rows = spark.createDataFrame([(1, i, f"the word{chr(97 + i // 26)}{chr(97 + i % 26)} alone{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)], "doc_id long, pos int, s string")
    assert L.links(rows, 0.5).isEmpty()
    ranks = L.lexrank(rows, 0.5, steps=2).collect()
    assert len(ranks) == 200 and {r.lexrank for r in ranks} == {1 / 200}


def test_a_document_of_many_blocks_and_both_walks(spark, monkeypatch):
    texts = documents(8) | {50: ". ".join(documents(k)[1] for k in range(40))}
    rows = S.sentences(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    links, ranks = plain(texts)
    monkeypatch.setattr(L, "BLOCK", 16)
    monkeypatch.setattr(L, "TOLD", 40)
    written, stored = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df: written.append(stored(df)) or written[-1])
    got = {(r.doc_id, r.a, r.b): r.cosine for r in L.links(rows).collect()}
    assert set(got) == set(links) and max(abs(got[k] - links[k]) for k in links) < 1e-6
    # Nothing as large as postings or pairs is written.
    assert max(t.count() for t in written) <= len(ranks)
    for walked in (10**6, 30):
        monkeypatch.setattr(L, "WALKED", walked)
        p = {(r.doc_id, r.pos): r.lexrank for r in L.lexrank(rows).collect()}
        assert set(p) == set(ranks) and max(abs(p[k] - ranks[k]) for k in ranks) < 1e-6


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, pos int, s string")
    assert L.lexrank(none, steps=1).isEmpty() and L.links(none).isEmpty()
