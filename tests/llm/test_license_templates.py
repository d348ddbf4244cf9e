from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.llm import license_templates as L
from tests.llm.conftest import clash, rows

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "License", "apache", "general", "public", "é", " ", "-", ".\n", "licensemit", "x9", "İ"]), max_size=20))
def test_base_is_the_contracts(parts):
    text = " ".join(parts)
    got = L.LicenseScanner(L.TEMPLATES).scan(text)
    assert tuple(got[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain(text)


def accepts(template, text):
    a = L.compile_template("x", template)
    words = text.split()
    return any(a.run([w.encode() for w in words], i)[0] for i in range(len(words)))


def test_optional_and_replaceable_regions():
    t = "granted to <<var:1-3>> the <<optional>>free <<optional>>open<</optional>><</optional>> work"
    assert accepts(t, "granted to me the work")
    assert accepts(t, "granted to a b c the free open work")
    assert accepts(t, "granted to a the free work")
    assert not accepts(t, "granted to the work")
    assert not accepts(t, "granted to a b c d the work")
    assert not accepts(t, "granted to a the open work")
    assert not accepts(t, "granted to a the free open works")


def test_templates_must_begin_with_a_mandatory_word():
    for bad in ("<<optional>>a<</optional>> b", "<<var:1-2>> b", "a <<optional>>b", ""):
        with pytest.raises(ValueError, match="mandatory"):
            L.compile_template("x", bad)


def test_notices_of_the_tables():
    scan = L.LicenseScanner(L.TEMPLATES).scan
    assert scan("Released under the MIT License.")["labels"] == "mit,mit-notice"
    assert scan("Licensed under the Apache License, Version 2.0.")["labels"] == "apache,apache-notice"
    assert scan("This work is licensed under the GNU General Public License, version 3.")["labels"] == "gpl,gpl-notice"
    assert scan("Licensed under CC BY-NC 4.0.") | {} == {"n_words": 7, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "cc-notice", "score": 1.0}
    near = scan("Licensed under the GNU Wrong Public License")
    assert near["labels"] == ""
    assert 0 < near["score"] < 1


def plain_accepts(parts, words):
    """By trying every way through the regions."""

    def ways(i, at):
        if i == len(parts):
            return True
        kind, value = parts[i]
        if kind == "word":
            return at < len(words) and words[at] == value and ways(i + 1, at + 1)
        if kind == "var":
            return any(ways(i + 1, at + n) for n in range(value[0], value[1] + 1) if at + n <= len(words))
        return ways(i + 1, at) or (words[at : at + len(value)] == value and ways(i + 1, at + len(value)))

    return any(ways(0, at) for at in range(len(words)))


WORD = st.sampled_from("abc")
PART = st.one_of(
    WORD.map(lambda w: ("word", w)), st.tuples(st.integers(0, 2), st.integers(0, 2)).map(lambda x: ("var", (x[0], x[0] + x[1]))), st.lists(WORD, min_size=1, max_size=3).map(lambda ws: ("optional", ws))
)


@settings(max_examples=600, deadline=None)
@given(st.lists(PART, max_size=6), st.lists(WORD, max_size=10))
def test_acceptance_against_brute_force(parts, words):
    parts = [("word", "a"), *parts]
    show = {"word": lambda v: v, "var": lambda v: f"<<var:{v[0]}-{v[1]}>>", "optional": lambda v: f"<<optional>>{' '.join(v)}<</optional>>"}
    assert accepts(" ".join(show[k](v) for k, v in parts), " ".join(words)) == plain_accepts(parts, words)


def test_whole_texts():
    """Each text is accepted with its regions filled in or left out, wherever it stands, and with one word changed it isn't."""
    scan = L.LicenseScanner(L.TEXTS).scan
    for label, template in L.TEXTS.items():
        full = re.sub(r"<<var:(\d+)-\d+>>", lambda m: " ".join(["Acme"] * max(1, int(m[1]))), template)
        bare = re.sub(r"(?s)<<optional>>.*?<</optional>>", "", full)
        full = re.sub(r"<</?optional>>", " ", full)
        for text in (full, bare, "* " + full.replace("\n", "\n * "), f"Copyright 2020 Acme\n\n{bare}\n\nint main"):
            found = scan(text)
            assert label in found["labels"].split(","), label
            assert found["score"] == 1.0
        words = bare.split()
        words[len(words) // 2] = "zebra"
        assert label not in scan(" ".join(words))["labels"].split(","), label


def test_odd_rows(spark, odd, none):
    got = rows(L.scan_licenses(odd))
    assert got == rows(L.scan_licenses(clash(odd)))
    assert len(got) == 9
    assert (1, 0, 0, None, None, "", "", 0.0) in got
    assert L.scan_licenses(none).collect() == []
