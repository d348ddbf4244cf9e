from __future__ import annotations

import hashlib
import re

import pytest

from fernwalk.llm import mixing as M
from tests.llm.conftest import clash, rows

DOCS = "doc_id long, text string, source string"


def plain_targets(sizes: dict):
    """By the words of the contract: shares, caps, and what is over shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def make(n=400, sources=7):
    out = []
    for i in range(n):
        s = f"s{min(i % 13, sources - 1)}" if i % 11 else None
        out.append((i, " ".join(["w"] * (1 + i * 7919 % 37)), s))
    return out


def test_targets_and_takings(spark):
    data = make()
    got = M.mix(spark.createDataFrame(data, DOCS)).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken % r.size == 0
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-5)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 37


def test_takings_follow_the_hash(spark):
    """Within a source the documents taken once more are those with the smallest hashes."""
    got = M.mix(spark.createDataFrame(make(), DOCS)).collect()
    for s in {r.source for r in got}:
        own = sorted((int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16), r.taken // r.size) for r in got if r.source == s)
        times = [t for _, t in own]
        assert times == sorted(times, reverse=True)
        assert times[0] - times[-1] <= 1


def test_boundaries_are_refined_as_deep_as_needed(spark, monkeypatch):
    df = spark.createDataFrame(make(60, 2), DOCS)
    want = rows(M.mix(df))
    monkeypatch.setattr(M, "STEP", 4)
    assert rows(M.mix(df)) == want


def test_odd_rows(spark, odd, none):
    got = M.mix(odd)
    assert rows(got) == rows(M.mix(clash(odd)))
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].size == by[2].size == by[3].size == 0
    assert by[4].size == len(re.findall(r"[^\x20\x09-\x0D]+", "lorem ipsum dolor " * 60_000))
    assert by[7].source_size == by[7].size == 6
    assert M.mix(none).collect() == []
    assert M.mix(odd.where("doc_id <= 3")).agg({"taken": "sum"}).first()[0] == 0


def test_rows_of_the_mix(spark, odd, none):
    some = clash(odd).drop("taken")
    out = M.mix_rows(some)
    assert out.columns == [*some.columns, "copies", "taken"]
    mixed = M.mix(odd).collect()
    got = sorted(((r.doc_id, r.taken) for r in out.collect()), key=repr)
    assert [x for x in got if x[1]] == sorted(((r.doc_id, r.taken) for r in mixed if r.taken), key=repr)
    assert min(r.copies for r in out.collect()) > 0
    # A source that is taken whole, once or more, loses no document for having no words.
    whole = {r.source for r in mixed if r.target >= r.source_size}
    assert {r.doc_id for r in mixed if not r.size and r.source in whole} <= {i for i, words in got if not words}
    assert (1, 0) in got
    assert M.mix_rows(none).collect() == []
