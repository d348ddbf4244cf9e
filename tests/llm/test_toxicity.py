from __future__ import annotations

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.llm import toxicity as X
from tests.llm.conftest import clash, rows


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(last[j] + (x != y), last[j + 1] + 1, now[-1] + 1))
        last = now
    return last[-1]


TERMS = [X.Term(t, False, 1.0) for t in ("abcab", "abba", "bcaca", "cabcab")] + [X.Term("bab", True, 1.0)]


@settings(max_examples=600, deadline=None)
@given(st.text("abc", max_size=8))
def test_the_automaton_accepts_what_is_near_enough(word):
    got = X.FuzzyLexicon(TERMS).match(word)
    near = [(d, i) for i, t in enumerate(TERMS) if not t.stem and (d := plain_distance(word, t.text)) <= X.edits_allowed(t.text)]
    want = (0, 4) if word.startswith("bab") else min(near, default=None)
    assert got == want


def swap_distance(a, b):
    """Levenshtein's distance in which neighbours that changed places are one edit."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


LEARNED = [X.Term(t, False, 1.0) for t in ("abcab", "abcaabcb", "cabcab")] + [X.Term(t, True, 1.0) for t in ("bcacbaca", "bab")]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("abc", max_size=11), st.sampled_from(LEARNED).flatmap(lambda t: st.permutations(t.text[:4]).map(lambda p: "".join(p) + t.text[4:]))))
def test_swaps_are_one_edit_and_stems_have_edits(word):
    got = X.FuzzyLexicon(LEARNED, swaps=True).match(word)
    least = {}
    for i, t in enumerate(LEARNED):
        parts = [word[:k] for k in range(len(word) + 1)] if t.stem else [word]
        if (d := min(swap_distance(p, t.text) for p in parts)) <= X.spare_edits(t):
            least[i] = d
    assert (got is None) == (not least)
    if got:
        assert got[0] == least[got[1]] == min(least.values())


def test_the_states_that_are_kept_are_bounded(monkeypatch):
    words = ["abcab", "acbab", "xbcacbaca", "bcacbcaab", "zzzz", "bacbac"] * 3
    want = [X.FuzzyLexicon(LEARNED, swaps=True).match(w) for w in words]
    monkeypatch.setattr(X, "STATES", 3)
    lexicon = X.FuzzyLexicon(LEARNED, swaps=True)
    assert [lexicon.match(w) for w in words] == want
    assert len(lexicon.sets) <= 3 + 10


def made(n, seed):
    """Plain rows, toxic ones with insults, and toxic ones of another language with a stem that labels alone tell."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmprt") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(r.randint(15, 80))]
        label = i % 4 == 0
        if label:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randrange(len(words)), r.choice(X.SEED_TERMS) if i % 8 else "zworf" + word())
        out.append((" ".join(words), int(label)))
    return out


@pytest.fixture(scope="module")
def model():
    return X.fit(made(1200, 1))


def test_learned_terms_and_held_out_accuracy(model):
    assert any("zworf".startswith(t.text[:4]) for t in model.terms if t.stem)
    score = X._scorer(model)
    fresh = made(600, 2)
    assert sum((score(t) >= 0.5) == bool(y) for t, y in fresh) / len(fresh) >= 0.99


def test_misspelled_insults_count_and_quoted_ones_dont(model):
    score = X._scorer(model)
    plain = made(40, 3)[1][0]
    abuse = plain + " you idoit? no: you idi0t you mor0n such sttupid tra5h patheti"
    assert score(abuse) >= 0.5
    quoted = plain + ' he called me "idiot" and "moron" and "stupid"'
    assert score(quoted) < 0.5
    assert score(plain + " you idiot and moron so stupid") >= 0.5


@pytest.mark.parametrize("term", ["grobian", "unverschämt"])
def test_misspelled_learned_terms_count(term):
    rows = [(t.replace("zworf", term + " "), y) for t, y in made(1200, 1)]
    score = X._scorer(X.fit(rows))
    plain = made(40, 3)[1][0]
    assert score(plain) < 0.5
    wrong = (term[:3] + "x" + term[4:], term[:3] + term[4:], term[:3] + term[2:], term[:2] + term[3] + term[2] + term[4:], "x" + term[1:])
    for w in (term, *wrong):
        assert score(f"{plain} {w} and {w} {plain}") >= 0.5, w


def test_swapped_letters_and_two_edits_count(model):
    m = X.Matcher(list(model.terms))
    found = {w: m.word(w) for w in ("idoit", "stuipd", "w0rthl3ss", "d1sgust1ng", "lovely")}
    assert {w: f and (f[0], model.terms[f[1]].text) for w, f in found.items()} == {
        "idoit": (1, "idiot"), "stuipd": (1, "stupid"), "w0rthl3ss": (2, "worthless"), "d1sgust1ng": (2, "disgusting"), "lovely": None,
    }


def test_quotes_must_close():
    assert X.quoted_positions('a "b c" d'.split()) == {1: 1.0, 2: 1.0}
    assert X.quoted_positions('a "b c d'.split()) == {}
    long = X.quoted_positions(['"a', *["b"] * 199, 'c"'])
    assert len(long) == 201
    assert long[0] == long[30] == long[170] == long[200] == 1.0
    assert long[60] == 0.5
    assert long[100] == 0.3


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(X, "MEMORY", 5)
    m = X.Matcher([X.Term(t, False, 1.0) for t in X.SEED_TERMS])
    for i in range(50):
        assert [h[0] for h in m.hits([f"word{i}", "idiot", f"stupid{i % 3}", "other"])][0] == 1
        assert len(m.clean) <= 5 + 4


def test_spark_scores_all_and_learns_from_its_share_only(spark, odd, none):
    data = [(i, t, "en", f"s{i % 3}", len(t)) for i, (t, _) in enumerate(made(400, 4))]
    docs = spark.createDataFrame(data, odd.schema)
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = [(i, y) for i, (_, y) in enumerate(made(400, 4))]
    labels = spark.createDataFrame(truth + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = X.learn(docs, labels)
    # Labels of held-out rows say nothing: turned round, they give the same model.
    turned = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in truth], "doc_id long, toxic int")
    assert X.learn(docs, turned) == model
    got = X.score_toxicity(clash(docs), model).collect()
    assert {r.doc_id for r in got if r.held_out} == held
    assert sum(r.predicted == dict(truth)[r.doc_id] for r in got if r.held_out) >= 0.95 * len(held)
    kept = X.drop_toxic(docs, model)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    odd_got = rows(X.score_toxicity(odd, model))
    assert len(odd_got) == 9
    assert all(0 <= r[2] < 0.5 and r[3] == 0 for r in odd_got)
    assert [r[1] for r in odd_got if r[0] is None] == [False]
    assert X.score_toxicity(none, model).collect() == []
    assert X.drop_toxic(clash(odd), model).columns == clash(odd).columns


def test_without_labels_only_general_insults_count(spark, odd, none):
    model = X.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    score = X._scorer(model)
    assert score("you stupid idiot, you are worthless trash") >= 0.5
    assert score("a fine day") < 0.5


def test_as_many_stems_as_the_rows_tell_and_short_words_as_a_whole():
    r = random.Random(3)
    words = ["".join(r.choice("aeiou") + r.choice("mnr") for _ in range(r.randint(1, 4))) for _ in range(40)]
    clean = lambda: " ".join(r.choices(words, k=60))
    word = lambda k: "q" + "".join(chr(98 + k // 10**p % 10) for p in range(3)) + "tt"
    rows = [(f"{clean()} {word(k)} {clean()}", 1) for k in range(230) for _ in range(6)]
    rows += [(f"{clean()} zog {clean()}", 1) for _ in range(12)] + [(clean(), 0) for _ in range(1500)]
    found = X.learn_stems(rows)
    assert X.Term("zog", False, found[[t.text for t in found].index("zog")].weight) in found
    stems = [t.text for t in found if t.stem]
    assert all(any(word(k).startswith(s) for s in stems) for k in range(230))
    # Where the beginnings of words tell nothing together, each word is one of its own.
    rows = [(f"{clean()} {chr(97 + k // 26)}{chr(97 + k % 26)}kx{k:03d} {clean()}", 1) for k in range(230) for _ in range(6)]
    assert len(X.learn_stems(rows + [(clean(), 0) for _ in range(1500)])) > 200
    assert X.Matcher(found).hits(["zog"]) and not X.Matcher([t for t in found if t.text == "zog"]).hits(["zogger"])
