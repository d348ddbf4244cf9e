from __future__ import annotations

import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.llm import simhash as S
from fernwalk.llm.components import connected_components
from tests.llm.conftest import clash, rows


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: dict):
    found = {i: i for i in values}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    ids = sorted(values)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (values[a] ^ values[b]).bit_count() <= 2 and root(a) != root(b):
                found[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_every_pair_within_the_radius_shares_a_table():
    masks = S.masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks.values())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_fingerprint_is_the_contracts(text):
    text = text.encode("utf-8", "replace").decode()
    assert S.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(random.Random(1).choice("ab cd ef gh ij kl".split()) for _ in range(500))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.fingerprint(text) == whole == plain_fingerprint(text) - (plain_fingerprint(text) >> 63 << 64)


def test_links_connect_what_brute_force_connects(spark):
    r = random.Random(3)
    values, base = {}, [r.getrandbits(64) for _ in range(30)]
    for i in range(400):
        v = r.choice(base)
        for _ in range(r.randint(0, 3)):
            v ^= 1 << r.randrange(64)
        values[i] = v
    # One large group whose members differ in a bit each, so that buckets hold many.
    for i in range(400, 520):
        values[i] = base[0] ^ 1 << r.randrange(64) ^ 1 << r.randrange(64)
    reps = {}
    for i, v in values.items():
        reps.setdefault(v, i)
    df = spark.createDataFrame([(v - (v >> 63 << 64), i) for v, i in reps.items()], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(S.links(df)).collect()}
    want = plain_components({i: v for v, i in reps.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200, 330)]
    hub = [(1000, i) for i in range(1001, 1400)]
    df = spark.createDataFrame(chain + hub + [(5, 5), (None, 6), (7, 8)], "a long, b long")
    found = {r.node: r.component for r in connected_components(df).collect()}
    assert {found[i] for i in range(200, 331)} == {200}
    assert {found[i] for i in range(1000, 1400)} == {1000}
    assert found[8] == found[7] == 7
    assert 5 not in found
    assert 6 not in found


def test_odd_rows(spark, odd, none):
    got = rows(S.near_duplicates(odd))
    assert got == rows(S.near_duplicates(clash(odd)))
    by_id = {(r[0], r[1]): r[2] for r in got}
    assert by_id[1, "0" * 16] == by_id[2, "0" * 16] == by_id[3, "0" * 16] == 1
    same = "%016x" % plain_fingerprint("the same text here")
    assert [r for r in got if r[1] == same] == sorted([(5, same, 5), (5, same, 5), (6, same, 5), (None, same, 5)], key=repr)
    assert S.near_duplicates(none).collect() == []


def test_null_ids_alone_have_no_component(spark):
    df = spark.createDataFrame([(None, "one two three four")], "doc_id long, text string")
    assert [r.component_id for r in S.near_duplicates(df).collect()] == [None]


def test_spark_hash_is_the_same_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (1 << 64) - 1 == xxhash.xxh64(b"a b c", seed=42).intdigest()
