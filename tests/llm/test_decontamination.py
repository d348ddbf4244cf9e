from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.llm import decontamination as D
from tests.llm.conftest import clash, rows

BENCH = "item_id long, text string"


def plain_distance(item, text):
    """Least edit distance between the item and any part of the text, by the table."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(last[j] + (a != b), last[j + 1] + 1, now[-1] + 1))
        last = now
    return min(last)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=90))
def test_bit_parallel_distance(item, text):
    assert D.Pattern(item).best(text) == plain_distance(item, text)


def edited(r, item, n):
    for _ in range(n):
        at = r.randrange(len(item))
        item = item[:at] + r.choice(("", "q", item[at] + "z")) + item[at + 1 :]
    return item


def test_nothing_within_the_budget_is_missed():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [(i, D.normalise(" ".join(word() for _ in range(r.randint(6, 40))))) for i in range(25)]
    m = D.Matcher(items)
    assert all(len(D.pieces(t, D.budget(t))) == D.budget(t) + 1 and "".join(p for _, p in D.pieces(t, D.budget(t))) == t for _, t in items)
    for _ in range(60):
        i, t = r.choice(items)
        text = " ".join(word() for _ in range(30)) + " " + edited(r, t, r.randint(0, D.budget(t) + 3)) + " " + " ".join(word() for _ in range(30))
        flat = D.normalise(text)
        want = {k: d for k, x in items if (d := plain_distance(x, flat)) <= D.budget(x)}
        assert m.find(text) == want


def test_blocks_and_stage(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog"), (2, "pack my box with five dozen liquor jugs"), (3, "short"), (4, None), (None, "how vexingly quick daft zebras jump today")]
    bench = spark.createDataFrame(items, BENCH)
    docs = spark.createDataFrame(
        [(1, "so THE QUICK, brown\nfox jumps over the lazy dog!"), (2, "pack my box with six dozen liquor jugs"), (3, "clean text"), (4, "short"), (5, None), (6, "xx how vexingly quick daft zebras jump todaY"), (6, "xx how vexingly quick daft zebras jump todaY")],
        "doc_id long, text string",
    )
    got = rows(D.find_leaks(docs, bench))
    assert got == sorted([(1, 1, 0), (2, 2, 3), (4, 3, 0), (6, None, 0), (6, None, 0)], key=repr)
    assert rows(D.find_leaks(docs, bench, block_chars=1)) == got
    assert [r.doc_id for r in D.drop_leaks(docs, bench, block_chars=1).orderBy("doc_id").collect()] == [3, 5]


def plain_leaks(docs, items):
    """Every item in every text, by the table of distances; short ones by words."""
    out = []
    for d, text in docs:
        flat, least = D.normalise(text), {}
        for i, item in items:
            item = D.normalise(item)
            if not item:
                continue
            if len(item) < D.WHOLE_WORDS:
                n = 0 if f" {item} " in f" {flat} " else 1
            else:
                n = plain_distance(item, flat)
            if n <= D.budget(item):
                least[i] = min(n, least.get(i, n))
        out += [(d, i, n) for i, n in least.items()]
    return sorted(out, key=repr)


def test_repeated_ids_and_short_items_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    items = [(r.choice((1, 2, 3, None)), " ".join(word() for _ in range(r.choice((1, 1, 2, 3, 8, 20))))) for _ in range(30)] + [(4, "... !"), (5, ""), (6, None)]
    items += items[:5]
    docs = []
    for i in range(40):
        text = " ".join(word() for _ in range(25))
        for _ in range(r.randint(0, 3)):
            item = r.choice(items[:30])[1]
            text += " " + edited(r, item, r.randint(0, 2)) + " " + word()
        docs.append((i if i % 7 else None, text))
    docs += docs[:6]
    bench, corpus = spark.createDataFrame(items, BENCH), spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_leaks(docs, items)
    assert len(want) > 30
    for block_chars in (10**6, 60, 1):
        assert rows(D.find_leaks(corpus, bench, block_chars=block_chars)) == want


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum dolor")], BENCH)
    assert rows(D.find_leaks(odd, bench)) == rows(D.find_leaks(clash(odd), bench)) == [(4, 1, 0)]
    assert D.find_leaks(none, bench).collect() == []
    assert D.find_leaks(odd, bench.limit(0)).collect() == []
    assert D.drop_leaks(clash(odd), bench).columns == clash(odd).columns
    assert D.drop_leaks(odd, bench.limit(0)).count() == 9


def test_many_shards_take_one_pass(spark):
    """One scan and one Python step for any number of shards, and the same rows with texts held in small parts."""
    items = [(i, " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[(i + k) % 26] * 5}" for k in range(0, 25, 3))) for i in range(20)]
    bench = spark.createDataFrame(items, BENCH)
    docs = spark.createDataFrame([(i, f"before {items[i % 20][1]} after" if i % 3 else "clean text") for i in range(600)], "doc_id long, text string").repartition(3)
    assert len(D.shards(bench, block_chars=60)) >= 10
    for made in (D.find_leaks(docs, bench, block_chars=60, held_chars=2000), D.drop_leaks(docs, bench, block_chars=60, held_chars=2000)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("Scan") == 1 and "Union" not in plan
    want = rows(D.find_leaks(docs, bench))
    assert rows(D.find_leaks(docs, bench, block_chars=60, held_chars=2000)) == want and len({d for d, _, _ in want}) == 400
    assert D.drop_leaks(docs, bench, block_chars=60, held_chars=2000).count() == 200
