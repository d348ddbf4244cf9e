"""Abbreviations and cuts of words against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

from fernwalk import queries
from fernwalk.operators import abbreviations as A
from fernwalk.operators import segment as G
from fernwalk.operators import sentences as S


def corpus():
    r = random.Random(7)
    words = ["rome", "met", "the", "garden", "smith", "walked", "home", "never", "jones", "city"]
    out = []
    for i in range(400):
        s = " ".join(r.choices(words, k=r.randint(4, 9)))
        out.append((i, f"{s} Mr. Smith and Dr. Jones at 5 p.m. in Rome.\n{s.capitalize()}. It rained, e.g. in the city. {s}!"))
    return [*out, (900, None), (901, ""), (902, "...")]


def plain_scores(texts):
    token = re.compile(r"(?:[^\W\d_]+\.)*[^\W\d_]+\.?")
    stopped, bare = Counter(), Counter()
    for t in texts:
        for x in token.findall((t or "").lower()):
            (stopped if x.endswith(".") else bare)[x.removesuffix(".")] += 1
    n, stops = sum(stopped.values()) + sum(bare.values()), sum(stopped.values())
    out = {}
    for w, k in stopped.items():
        b, letters = bare[w], len(w.replace(".", ""))
        usual = k * math.log(stops / n) + (b * math.log(1 - stops / n) if b else 0)
        always = k * math.log(A.ALWAYS) + b * math.log(1 - A.ALWAYS)
        score = -2 * (usual - always) * math.exp(-letters) * (len(w) - letters + 1) * float(letters) ** -b
        if score >= A.LEAST:
            out[w] = score
    return out


def test_abbreviations_are_learned(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r.word: r.score for r in A.learn_abbreviations(docs).collect()}
    want = plain_scores([t for _, t in corpus()])
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-6 for w in want)
    assert {"mr", "dr", "p.m", "e.g"} <= set(got) and not {"rome", "city"} & set(got)


def test_their_stops_end_nothing(spark):
    docs = spark.createDataFrame([(1, "Mr. Smith met Dr. Jones at 5 p.m. in Rome. He left."), (2, "e.g. this\nMR. X. ended"), (3, None), (4, "armr. Yes")], "doc_id long, text string")
    got = [(r.doc_id, r.s) for r in A.split_learned(docs, ["mr", "dr", "p.m", "e.g"]).orderBy("doc_id", "pos").collect()]
    assert got == [(1, "Mr. Smith met Dr. Jones at 5 p.m. in Rome"), (1, "He left."), (2, "e.g. this"), (2, "MR. X"), (2, "ended"), (4, "armr"), (4, "Yes")]
    assert A.split_learned(docs, []).collect() == S.sentences(docs).collect()


def plain_cut(text, cost, unknown):
    """The least cost over all cuts."""
    best = math.inf
    for marks in itertools.product((0, 1), repeat=max(len(text) - 1, 0)):
        ends = [i + 1 for i, m in enumerate(marks) if m] + [len(text)]
        parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        best = min(best, sum(cost.get(p, unknown if len(p) == 1 else math.inf) for p in parts))
    return best


def test_cuts_are_the_likeliest():
    r = random.Random(1)
    words = ["ab", "abc", "c", "bca", "cab", "aab", "b"]
    cost = {w: r.uniform(1, 6) for w in words}
    for _ in range(200):
        text = "".join(r.choices("abcd", k=r.randint(0, 10)))
        cut = G.cut_words(text, cost, 9.0)
        assert "".join(cut) == text
        if text:
            assert abs(sum(cost.get(w, 9.0) for w in cut) - plain_cut(text, cost, 9.0)) < 1e-9


def test_a_long_text_is_cut_and_counted_in_linear_time(spark):
    """Cuts cost as much as words begin at a place; before, each place tried 32 pieces and ends copied all those before them."""
    cost = {"ab": 1.0, "abc": 1.5, "c": 1.0, "x" * 32: 9.0}
    looked = Counter()

    class Node(dict):
        def get(self, k, default=None):
            looked["steps"] += 1
            return super().get(k, default)

    def noted(node):
        return Node({k: noted(v) if k else v for k, v in node.items()})

    assert G.cut_words("abc" * 500, cost, 9.0, noted(G.branches(cost))) == ["abc"] * 500
    assert looked["steps"] <= 4 * 1500
    df = spark.createDataFrame([(1, ["ab", "c", "äöü"]), (2, []), (3, None)], "i int, w array<string>")
    assert {r.i: r.e for r in df.select("i", G.ends("w").alias("e")).collect()} == {1: [2, 3, 6], 2: [], 3: []}


def test_texts_without_spaces(spark):
    docs = spark.createDataFrame([(1, "the quick fox the lazy dog"), (2, "the dog"), (3, None)], "doc_id long, text string")
    run = spark.createDataFrame([(1, "thequickdog 12 zfox"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.words for r in G.cut_texts(run, G.lexicon(docs)).collect()}
    assert got == {1: ["the", "quick", "dog", "z", "fox"], 2: [], 3: []}
    none = docs.where("false")
    assert {r.doc_id: r.words for r in G.cut_texts(docs, G.lexicon(none)).collect()}[2] == list("thedog")


def test_many_texts_are_cut_as_each_one(monkeypatch):
    r = random.Random(5)
    words = {"".join(r.choices("abcdeé𐐨", k=r.randint(1, 6))) for _ in range(400)} | {"f" * 32, "g" * 33}
    cost = {w: float(r.randint(1, 9)) for w in words}
    texts = ["".join(r.choices("abcdeé𐐨fgz", k=r.choice([0, 1, 40, 300]))) for _ in range(60)] + ["f" * 70, "", "g" * 40, "".join(words)]
    for size in (16, 1 << 15):
        monkeypatch.setattr(G, "CHARACTERS", size)
        for known in ({w: c for w, c in cost.items() if len(w) <= G.LONGEST}, {}):
            want = [list(itertools.accumulate(map(len, G.cut_words(t, known, 9.5)))) for t in texts]
            assert [e.tolist() for e in G.Cutter(known, 9.5).ends(iter(texts))] == want


def test_cuts_hold_little():
    """A trie of dicts and the words of whole batches took hundreds of MB in each of two workers of a task."""
    r = random.Random(6)
    cost = {"".join(r.choices("abcdefghij", k=12)): r.uniform(5, 9) for _ in range(20_000)}
    words = list(cost)
    tracemalloc.start()
    trie = G.branches(cost)
    dicts = tracemalloc.get_traced_memory()[0]
    del trie
    cutter = G.Cutter(cost, 20.0)
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    cut = sum(len(e) for e in cutter.ends("".join(r.choices(words, k=500)) for _ in range(100)))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert cut >= 50_000 and peak < 60e6
    assert cutter.keys.nbytes + cutter.nodes.nbytes + cutter.cost.nbytes < dicts / 2


def test_cut_again_in_one_pass(spark, tmp_path):
    """Before, the words of the cut went from one worker by the JVM to another one."""
    texts = [(1, "The quick fox. the lazy dog"), (2, "THE dogs 12"), (3, None), (4, "12"), (5, ""), (None, "fox fox")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = queries.segment_words(spark, str(tmp_path))
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    table, unknown = G.costs(G.lexicon(docs))
    want = {}
    for i, t in texts:
        own = re.findall(r"[^\W\d_]+", (t or "").lower())
        cut = G.cut_words("".join(own), table, unknown)
        same = set(itertools.accumulate(map(len, own))) & set(itertools.accumulate(map(len, cut)))
        want[i] = (None if t is None else len(own), len(cut), len(same))
    assert {r.doc_id: (r.n_words, r.n_cut, r.n_same) for r in got.collect()} == want
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_words:int,n_cut:int,n_same:int>"
