"""Words are counted within a sentence or document, so no task sorts or hashes postings of many."""

from __future__ import annotations

import math
import re
from collections import Counter

from fernwalk.operators import rank
from fernwalk.operators import sentences as S

ROWS = [(1, 0, "The fox the hen"), (1, 1, "12 34"), (1, 2, "hen"), (2, 0, "é é É x"), (2, 0, "x the"), (None, 0, "fox fox"), (3, 5, "")]


def counts():
    out: dict = {}
    for d, p, s in ROWS:
        out.setdefault((d, p), Counter()).update(re.findall(r"[^\W\d_]+", s.lower()))
    return out


def test_counts_with_repeated_places(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, pos int, s string").repartition(3)
    got = {(r.doc_id, r.pos, r.term): r.tf for r in S.postings(df).collect()}
    assert got == {(*k, t): n for k, c in counts().items() for t, n in c.items()}
    central = {(r.doc_id, r.pos): r.centrality for r in rank.centrality(df).collect()}
    whole: dict = {}
    for (d, _), c in counts().items():
        whole.setdefault(d, Counter()).update(c)
    size = lambda c: math.sqrt(sum(n * n for n in c.values()))
    want = {(d, p): sum(n * whole[d][t] for t, n in c.items()) / (size(c) * size(whole[d])) for (d, p), c in counts().items() if c}
    assert set(central) == set(want) and all(abs(central[k] - want[k]) < 1e-8 for k in want)


def test_nothing_is_sorted_or_hashed_by_word(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, pos int, s string")
    for made in (S.postings(df), rank.centrality(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and " HashAggregate" not in plan
        assert "term" not in "".join(line for line in plan.split("\n") if "Exchange" in line or "Sort " in line or "Aggregate(" in line)
