"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon holds general insults, and stems and whole words learned from labelled
rows. Its trie is intersected with a Levenshtein automaton, state by state as words
need it, so misspelled terms are found too, learned ones like the others. Hits are weighed by the window around them:
whether they stand in quotes or after words that report speech, and how many
others are near. A logistic regression over these makes the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.llm.common import filter_rows, map_columns

#: General insults that need no labels.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "disgusting", "worthless", "clown")
#: Words that report speech or talk about a word, in the four languages.
CUES = frozenset(
    "said says called wrote quoted quote word term sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split()
)
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
#: A hit so many words from the nearer edge of its quote counts as quoted; farther in, less so by the distance.
QUOTE_REACH = 30
#: Rows of each label that the model is fitted on at most, the first by a hash of their ids.
SAMPLE_ROWS = 3000
#: Words on either side of a hit that make its window.
REACH = 25
#: Terms with so many letters may be misspelled by one edit; shorter ones may not.
EDIT_LETTERS = 5
#: Terms with so many letters may be misspelled by two edits.
TWO_EDIT_LETTERS = 8
STEM_LENGTHS = range(4, 11)
#: Stems need this many toxic rows, and the share of toxic rows among those that have them. Each takes its rows
#: with it, so there are no more of them than the sample has rows for.
STEM_ROWS, STEM_SHARE = 5, 0.8
#: Words known to hold no term that a task remembers.
MEMORY = 150_000
#: States of the automaton that a task remembers.
STATES = 50_000
HOLD_OUT = 5

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\w*@$!]+")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float


def edits_allowed(term: str) -> int:
    return int(len(term) >= EDIT_LETTERS) + int(len(term) >= TWO_EDIT_LETTERS)


def stem_edits(stem: str) -> int:
    """Edits within a stem: one fewer than a term of that length has, as any ending follows."""
    return max(0, edits_allowed(stem) - 1)


def spare_edits(term: Term) -> int:
    return stem_edits(term.text) if term.stem else edits_allowed(term.text)


class FuzzyLexicon:
    """The trie of the terms, walked together with a Levenshtein automaton.

    A state of the product is a set of (trie node, edits spent, letter awaited);
    states and their moves are made when a word first needs them and kept. Stems
    accept any ending after a beginning within their edits; terms accept words
    within theirs. With ``swaps``, two neighbouring letters that changed places
    are one edit: after the second of them the first is awaited.
    """

    def __init__(self, terms: list[Term], swaps: bool = False):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.deepest: list[int] = [0]
        self.terms, self.swaps = terms, swaps
        self.spare = [spare_edits(t) for t in terms]
        for i, t in enumerate(terms):
            node, spare = 0, self.spare[i]
            self.deepest[0] = max(self.deepest[0], spare)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.deepest.append(0)
                node = self.children[node][c]
                self.deepest[node] = max(self.deepest[node], spare)
            self.ends[node].append(i)
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.first = self._state({(0, 0, "")})

    def _close(self, held: set[tuple[int, int, str]]) -> frozenset:
        """With letters of the term left out, and nothing that another beats."""
        todo, best = list(held), {}
        while todo:
            node, spent, awaited = todo.pop()
            if best.get((node, awaited), 9) <= spent:
                continue
            best[node, awaited] = spent
            if not awaited:
                todo += [(n, spent + 1, "") for n in self.children[node].values() if spent < self.deepest[n]]
        return frozenset((node, spent, awaited) for (node, awaited), spent in best.items())

    def _state(self, reached: set[tuple[int, int, str]]) -> int:
        held = self._close(reached)
        if held not in self.ids:
            self.ids[held] = len(self.sets)
            self.sets.append(held)
            self.moves.append({})
            done = [(spent, i) for node, spent, awaited in held if not awaited for i in self.ends[node] if spent <= self.spare[i]]
            self.accepts.append(min(done, default=None))
            self.stems.append(min((d for d in done if self.terms[d[1]].stem), default=None))
        return self.ids[held]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, spent, awaited in self.sets[state]:
            if awaited:
                if awaited == c:
                    out.add((node, spent, ""))
                continue
            if (n := self.children[node].get(c)) is not None and spent <= self.deepest[n]:
                out.add((n, spent, ""))
            if spent < self.deepest[node]:
                out.add((node, spent + 1, ""))
                for a, n in self.children[node].items():
                    if spent < self.deepest[n]:
                        out.add((n, spent + 1, ""))
                        if self.swaps and a != c and (m := self.children[n].get(c)) is not None and spent < self.deepest[m]:
                            out.add((m, spent + 1, a))
        to = self._state(out) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """The term that a word holds and the edits spent: a stem without edits, or else the fewest."""
        if len(self.sets) > STATES:
            self._forget()
        state, stem = self.first, None
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return stem
            state = to
            if (a := self.stems[state]) is not None and (stem is None or a[0] < stem[0] or a[0] == stem[0] == 0):
                stem = a
        found = self.accepts[state]
        return found if stem is None or found is not None and found[0] < stem[0] else stem


def form(word: str) -> str:
    """A word without the signs around it."""
    return _EDGE.sub("", word)


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Matcher:
    """Hits of a lexicon in texts; it remembers words that hold no term."""

    def __init__(self, terms: list[Term]):
        self.lexicon = FuzzyLexicon(terms, swaps=True)
        self.clean: set[str] = set()
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, raw: str) -> tuple[int, int] | None:
        core = form(raw)
        if found := self.lexicon.match(core):
            return found
        parts = _INNER.split(core)
        return min((f for p in parts if (f := self.lexicon.match(p))), default=None) if len(parts) > 1 else None

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """Position, edits and term of each hit."""
        new = set(words) - self.clean
        some = False
        for w in new:
            if w in self.known:
                some = True
                continue
            found = self.word(w)
            if found is None:
                self.clean.add(w)
            else:
                self.known[w] = found
                some = True
        if len(self.clean) > MEMORY:
            self.clean.clear()
        if len(self.known) > MEMORY:
            self.known = {w: self.known[w] for w in new if w in self.known}
        return [(i, *self.known[w]) for i, w in enumerate(words) if w in self.known] if some else []


def quoted_positions(words: list[str]) -> dict[int, float]:
    """How far each word inside quotes that are closed within the text is quoted: wholly near an edge, less deep within."""
    out, opened = {}, None
    for i, w in enumerate(words):
        for c in w:
            if opened is None:
                if c in QUOTES:
                    opened = (QUOTES[c], i)
            elif c == opened[0]:
                first = opened[1]
                out.update((k, min(1.0, QUOTE_REACH / max(1, min(k - first, i - k)))) for k in range(first, i + 1))
                opened = None
    return out


FEATURES = 9


def features(words: list[str], hits: list[tuple[int, int, int]], terms: list[Term], trust: dict[str, float]) -> list[float]:
    """Sums over hits, apart for those spoken and those quoted, and the fullest window.

    ``trust``: how far a misspelled form is a term, by the labelled rows; for
    one that they don't have 1, or a half if it is two edits away.
    """
    if not hits:
        return [0.0] * FEATURES
    marks = quoted_positions(words)
    exact = fuzzy = stems = told = 0.0
    spoken: list[tuple[int, float]] = []
    names = set()
    for i, edits, t in hits:
        weight = terms[t].weight * (trust.get(form(words[i]), 1.0 / edits) if edits else 1.0)
        share = 1.0 if any(words[j].strip(".,;:!?\"“”«»'") in CUES for j in range(max(0, i - 4), i)) else marks.get(i, 0.0)
        told += weight * share
        if share == 1.0:
            continue
        weight *= 1 - share
        if edits:
            fuzzy += weight
        elif terms[t].stem:
            stems += weight
        else:
            exact += weight
        if weight > 0:
            spoken.append((i, weight))
            names.add(t)
    window, low, held = 0.0, 0, 0.0
    for i, weight in spoken:
        held += weight
        while spoken[low][0] < i - 2 * REACH:
            held -= spoken[low][1]
            low += 1
        window = max(window, held)
    total = exact + stems + fuzzy
    return [
        math.log1p(exact), math.log1p(stems), math.log1p(fuzzy), math.log1p(told), math.log1p(window),
        100 * total / (len(words) + 50), float(total > 0), math.log1p(len(names)), float(exact + stems > 1.5),
    ]


def _starts(text: str) -> set[str]:
    """Beginnings of a text's words; a word too short for one counts as a whole, which ``WHOLE`` marks."""
    words = {form(w) for w in set(tokens(text))}
    short = {w + WHOLE for w in words if 1 < len(w) < STEM_LENGTHS[0]}
    return short | {w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k}


WHOLE = "\0"


def learn_stems(rows: list[tuple[str, int]]) -> list[Term]:
    """Beginnings of words that toxic rows have and others don't, chosen one after another.

    Each is chosen for the toxic rows that have no term yet. Only beginnings that
    enough toxic rows have are counted in the others, so little is held.
    """
    seed = Matcher([Term(t, False, 1.0) for t in SEED_TERMS])
    plain = [text for text, label in rows if label and not any(edits == 0 for _, edits, _ in seed.hits(tokens(text)))]
    bad = Counter()
    for text in plain:
        bad.update(_starts(text))
    wanted = {s for s, n in bad.items() if n >= STEM_ROWS}
    bad, good, left = Counter(), Counter(), []
    for text in plain:
        left.append(_starts(text) & wanted)
        bad.update(left[-1])
    for text, label in rows:
        if not label:
            good.update(_starts(text) & wanted)
    out: list[Term] = []
    open_ = Counter(bad)
    while True:
        best, gain = None, 0.0
        for s, n in open_.items():
            if n >= STEM_ROWS and bad[s] / (bad[s] + good[s]) >= STEM_SHARE:
                g = n - 3 * good[s] - 0.01 * len(s)
                if g > gain or g == gain and best is not None and s < best:
                    best, gain = s, g
        if best is None:
            break
        out.append(Term(best.removesuffix(WHOLE), not best.endswith(WHOLE), (bad[best] + 0.5) / (bad[best] + good[best] + 1.0)))
        rest = []
        for starts in left:
            if best in starts:
                open_.subtract(starts)
            else:
                rest.append(starts)
        left = rest
        open_ = +open_
    return out


def learn_words(rows: list[tuple[str, int]], stems: list[Term]) -> list[Term]:
    """Whole words of toxic rows that begin with a stem, so that their misspellings are found.

    Without edits such a word is its stem's; words too short for edits add nothing.
    """
    weight = {t.text: t.weight for t in stems}
    starts = tuple(weight)
    bad, good = Counter(), Counter()
    for text, label in rows:
        words = {form(w) for w in set(tokens(text))}
        (bad if label else good).update(w for w in words if w.startswith(starts) and edits_allowed(w) and not _INNER.search(w))
    return [
        Term(w, False, max(weight[w[:k]] for k in STEM_LENGTHS if w[:k] in weight))
        for w, n in sorted(bad.items())
        if w not in weight and w not in SEED_TERMS and n / (n + good[w]) >= STEM_SHARE
    ]


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    trust: dict[str, float]
    weights: tuple[float, ...]
    bias: float

    def score(self, row: list[float]) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, row, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def misspelled(word: str, term: str, salt: int) -> str:
    """``word`` with one edit within ``term``."""
    pick = zlib.crc32(f"{word} {salt}".encode())
    at = word.find(term) + 1 + pick % (len(term) - 1)
    return word[:at] + (word[at + 1 :], "*" + word[at + 1 :], word[at] + word[at:], "x" + word[at:])[pick // 97 % 4]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps with a ridge on all but the bias."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(full.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -40, 40)))
        grad = full.T @ (p - y) + pull * w
        move = np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + np.diag(pull), grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from texts and labels. Without rows of both labels only general insults count."""
    terms = [Term(t, False, 1.0) for t in SEED_TERMS]
    if len({label for _, label in rows}) < 2:
        return Model(tuple(terms), {}, (3.0, 3.0, 1.0, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0), -4.0)
    terms += (stems := learn_stems(rows))
    terms += learn_words(rows, [t for t in stems if t.stem])
    matcher = Matcher(terms)
    good, bad = Counter(), Counter()
    for text, label in rows:
        words = tokens(text)
        (bad if label else good).update({form(words[i]) for i, edits, _ in matcher.hits(words) if edits})
    x, y = [], []
    for n, (text, label) in enumerate(rows):
        words = tokens(text)
        hits = matcher.hits(words)
        # A row's own label mustn't speak for its forms.
        own = {form(words[i]) for i, edits, _ in hits if edits}
        x.append(features(words, hits, terms, {f: _trust(bad[f] - (label == 1), good[f] - (label == 0)) for f in own}))
        y.append(label)
        # The labelled rows spell their terms well; toxic ones are shown again with terms misspelled.
        if label and (wrong := {i: t for i, edits, t in hits if not edits}):
            again = [misspelled(w, terms[wrong[i]].text, n) if i in wrong else w for i, w in enumerate(words)]
            if found := matcher.hits(again):
                x.append(features(again, found, terms, {}))
                y.append(1)
    w, bias = fit_logistic(np.array(x), np.array(y, float))
    trust = {f: _trust(bad[f], good[f]) for f in good.keys() | bad.keys()}
    return Model(tuple(terms), trust, tuple(map(float, w)), bias)


def _trust(bad: int, good: int) -> float:
    return (bad + 1.0) / (bad + 20 * good + 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``rows`` labelled rows of each label that aren't held out.

    They are the first by a hash of their ids; ids are picked from the labels, so
    at most ``2 * rows`` texts come to the driver. Rows with a null id or label
    teach nothing.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))
    )
    order = (F.xxhash64("_id"), F.col("_id"))
    picked = usable.where("_label = 1").orderBy(*order).limit(rows).union(usable.where("_label = 0").orderBy(*order).limit(rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = texts.join(F.broadcast(picked), F.col("id") == F.col("_id"))
    # Ids may repeat in the documents; one text of each is taken, so the bound holds.
    held = got.groupBy("_id").agg(F.min("text").alias("text"), F.max("_label").alias("label")).collect()
    return fit(sorted((r["text"] or "", r["label"]) for r in held))


def _scorer(model: Model):
    terms = list(model.terms)
    matcher = Matcher(terms)
    clean = model.score([0.0] * FEATURES)

    def score(text: str | None) -> float:
        words = tokens(text)
        hits = matcher.hits(words)
        return model.score(features(words, hits, terms, model.trust)) if hits else clean

    return score


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)``, one row for each row of ``docs``.

    Null and empty texts hold no term and get the score of such a text. Only the
    text makes the score. Repeated rows and null ids (never held out) stay, other
    columns are ignored, and an empty table gives an empty result.
    Very long texts are scored whole.
    """

    def start():
        score = _scorer(model)

        def work(rows):
            scores = [score(t) for t in rows[text_col]]
            return {id_col: rows[id_col], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_columns(docs.select(id_col, text_col), start, f"`{id_col}` {kind}, score double, predicted int")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without those that the model predicts toxic; nothing is shuffled."""

    def start():
        score = _scorer(model)
        return lambda texts: [score(t) < 0.5 for t in texts]

    return filter_rows(docs, text_col, start)
