"""License scans: template markup compiled to token automata.

A template is text with ``<<optional>> ... <</optional>>`` regions and
``<<var:a-b>>`` gaps of a to b tokens of any wording. It is compiled to a
nondeterministic automaton over word tokens; a text is accepted where all
mandatory tokens stand in order with nothing else between them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fernwalk.llm.common import LOWER, UPPER, map_columns
from fernwalk.llm.license_texts import TEXTS

#: Every byte that ends a word becomes a space, A-Z become a-z; bytes from 0x80 stay.
_TOKENS = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
#: Phrases and labels of the contract.
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: Public license notices and grants that stand by themselves, and whole texts, as templates.
TEMPLATES = TEXTS | {
    "mit-notice": "released under the mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of <<var:1-8>> "
        "<<optional>>and associated documentation files<</optional>> <<optional>>the software<</optional>> "
        "to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software"
    ),
    "apache-notice": "licensed under the apache license version <<var:1-2>>",
    "apache-grant": (
        "you may not use this file except in compliance with the license "
        "<<optional>>you may obtain a copy of the license at <<var:1-12>><</optional>> "
        "unless required by applicable law or agreed to in writing software distributed under the license"
    ),
    "gpl-notice": "licensed under the gnu <<optional>>lesser<</optional>> <<optional>>affero<</optional>> general public license version <<var:1-2>>",
    "gpl-grant": (
        "redistribute it and or modify it under the terms of the gnu <<optional>>lesser<</optional>> "
        "<<optional>>affero<</optional>> general public license as published by <<var:1-6>> either version <<var:1-2>>"
    ),
    "cc-notice": (
        "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by <<optional>>nc<</optional>> "
        "<<optional>>sa<</optional>> <<optional>>nd<</optional>> <<var:1-2>>"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met"
    ),
}


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TOKENS).split()


@dataclass
class Automaton:
    """``step[state]``: the token each state waits for and what follows; None waits for any token."""

    label: str
    step: list[tuple[bytes | None, int]] = field(default_factory=list)
    skip: dict[int, list[int]] = field(default_factory=dict)
    need: list[int] = field(default_factory=list)
    mandatory: int = 0

    @property
    def first(self) -> bytes:
        return self.step[0][0]

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skip.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def run(self, words: list[bytes], at: int) -> tuple[bool, int]:
        """Whether the template stands at ``at``, and how many mandatory tokens were met."""
        end, best = len(self.step), 0
        states = self.closure({0})
        while states:
            if end in states:
                return True, self.mandatory
            best = max(best, *(self.need[s] for s in states))
            if at == len(words):
                break
            states = self.closure({self.step[s][1] for s in states if self.step[s][0] in (None, words[at])})
            at += 1
        return False, best


def compile_template(label: str, text: str) -> Automaton:
    """Leading optional regions aren't needed to accept, so a template must begin with a mandatory token."""
    a, opened, need = Automaton(label), [], 0
    marks = [(m[0],) if m[0].startswith("<<") else tokens(m[0]) for m in re.finditer(r"<<[^<>]*>>|[^<>]+", text)]
    for part in (x for xs in marks for x in xs):
        here = len(a.step)
        if part == "<<optional>>":
            opened.append(here)
        elif part == "<</optional>>":
            a.skip.setdefault(opened.pop(), []).append(here)
        elif isinstance(part, str) and (m := re.fullmatch(r"<<var:(\d+)-(\d+)>>", part)):
            least, most = int(m[1]), int(m[2])
            for i in range(most):
                a.step.append((None, here + i + 1))
                a.need.append(need)
                if i >= least:
                    a.skip.setdefault(here + i, []).append(here + most)
        elif isinstance(part, str):
            raise ValueError(f"{label}: unknown markup {part}")
        else:
            a.step.append((part, here + 1))
            a.need.append(need)
            need += not opened
    if opened or not a.step or a.step[0][0] is None or 0 in a.skip:
        raise ValueError(f"{label}: a template begins with a mandatory token and closes its regions")
    a.need.append(need)
    a.mandatory = need
    return a


class LicenseScanner:
    def __init__(self, templates: dict[str, str]):
        self.automata = [compile_template(k, v) for k, v in templates.items()]
        self.by_first: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            self.by_first.setdefault(a.first, []).append(a)

    def scan(self, text: str | None) -> dict:
        flat = (text or "").encode("utf-8", "surrogatepass").translate(_TOKENS)
        words = flat.split()
        places: list[tuple[int, str]] = []
        if b"license" in flat:
            joined = b" %b " % b" ".join(words)
            for phrase, label in PHRASES:
                wanted, at = b" %b " % phrase, -1
                seen, counted = 0, 0
                while (at := joined.find(wanted, at + 1)) >= 0:
                    seen += joined.count(b" ", counted, at)
                    counted = at
                    places.append((seen, label))
        labels, score = {x for _, x in places}, 0.0
        for first in self.by_first:
            if first in flat:
                at = -1
                while True:
                    try:
                        at = words.index(first, at + 1)
                    except ValueError:
                        break
                    for a in self.by_first[first]:
                        accepted, met = a.run(words, at)
                        score = max(score, met / a.mandatory)
                        if accepted:
                            labels.add(a.label)
        starts = [p for p, _ in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({x for _, x in places})),
            "labels": ",".join(sorted(labels)),
            "score": score,
        }


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: base phrases, labels of accepted templates, and a score.

    ``score`` is the largest share of a template's mandatory tokens met in one run,
    1 where it is accepted. A null or empty text has no words, no labels and
    score 0. Repeated rows and null ids stay, other columns are ignored, and an
    empty table gives an empty result.
    Very long texts are scanned whole.
    """
    templates = TEMPLATES if templates is None else templates

    def start():
        scanner = LicenseScanner(templates)

        def work(rows):
            found = [scanner.scan(t) for t in rows[text_col]]
            return {id_col: rows[id_col]} | {k: [x[k] for x in found] for k in FIELDS}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(
        docs.select(id_col, text_col),
        start,
        f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
