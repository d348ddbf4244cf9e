from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.llm import url_filters as U
from tests.llm.conftest import rows

URL = st.lists(st.sampled_from(["http://", "://", "net", "example.net", "www.", "/en/", "/de/", "example.com", "org", "/fr/", "?", "#", "x", "/", ".", "A", "spam-farm", "ads-track", "casino", "-win", ":80"]), max_size=9).map("".join)


def plain_split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [r for r in U.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


@settings(max_examples=400, deadline=None)
@given(URL)
def test_split_and_host_rules(url):
    host, path = U.split_url(url)
    assert (host, path) == plain_split(url)
    by_host = {}
    for r in U.HOST_RULES:
        by_host.setdefault(r.host, []).append(r)
    assert U.host_rule(host, path, by_host) == plain_rule(host, path)


@settings(max_examples=400, deadline=None)
@given(URL, st.dictionaries(st.sampled_from(["spam", "farm", "ads", "track", "casino", "win"]), st.integers(0, 9)))
def test_the_index_finds_what_all_rules_find(url, counts):
    every = {r.action for r in U.PATTERN_RULES if re.search(r.regex(), url.lower(), re.S)}
    assert U.RuleIndex(U.PATTERN_RULES, counts).verdict(url) == ("block" if every == {"block"} else "allow")


def test_a_rule_stands_under_its_rarest_token():
    r = (U.PatternRule("block", "^cheap-pills^"),)
    assert list(U.RuleIndex(r, {"cheap": 9, "pills": 2}).by_token) == ["pills"]
    assert U.PatternRule("block", "*ads^x*").tokens() == []


def test_thousands_of_rules_from_a_table(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 4)))
    patterns = [(r.choice(["block"] * 60 + ["allow"]), r.choice(("^{}^", "/{}/*", "^{}-{}^", "{}*{}", "*{}^", "?{}=")).format(word(), word())) for _ in range(4000)]
    rules = U.rules_of(spark.createDataFrame([*patterns, *patterns[:9]], "action string, pattern string"))
    assert {(x.action, x.pattern) for x in rules} == set(patterns)
    urls = [(i, f"http://{word()}.{word()}.Example/{word()}/{word()}-{word()}?{word()}={word()}") for i in range(300)] + [(300, "http://h.x/" + "ab-cd/" * 20_000 + "end")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {x.page_id: x.verdict for x in U.judge_urls(df, (), rules).collect()}
    compiled = [(re.compile(x.regex(), re.S), x.action) for x in rules]
    assert len(got) == 301
    for i, url in urls[:300]:
        every = {action for pattern, action in compiled if pattern.search(url.lower())}
        assert got[i] == ("block" if every == {"block"} else "allow")
    assert set(got.values()) == {"block", "allow"}
    for bad in (("drop", "^x^"), ("block", ""), ("block", None)):
        with pytest.raises(ValueError, match="not a rule"):
            U.rules_of(spark.createDataFrame([bad], "action string, pattern string"))


def test_odd_rows(spark):
    data = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.net"), (5, "http://a.net/"), (5, "http://a.net/"), (None, "https://x.example.net/en/1"), (7, "http://spam-farm.example.org/fr/1"), (8, "http://spam-farm.example.org/en/1")]
    df = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in data], "page_id long, url string, host string, rule string, verdict string")
    assert rows(U.judge_urls(df)) == sorted(
        [
            (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "", None, "allow"),
            (5, "a.net", "/", "net/", "block"), (5, "a.net", "/", "net/", "block"), (None, "x.example.net", "/en/1", "example.net/en/", "allow"),
            (7, "spam-farm.example.org", "/fr/1", "org/fr/", "allow"), (8, "spam-farm.example.org", "/en/1", None, "block"),
        ],
        key=repr,
    )
    assert U.judge_urls(df.limit(0)).collect() == []


def test_very_long_urls(spark):
    long = "a" * 500_000
    urls = [f"https://x.example.net/en/{long}", f"https://{long}.example.net/{long}?{long}", f"https://h.example/{'banner/' * 70_000}", long, f"https://h.example/{'%2F=&' * 100_000}"]
    got = [(r.rule, r.verdict, len(r.host), len(r.path)) for r in U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[0] == ("example.net/en/", "allow", 13, 500_004)
    assert got[1] == ("net/", "block", 500_012, 500_001)
    assert got[2][2:] == (9, 490_001) and got[2][0] is None
    assert got[3] == (None, "allow", 0, 0)
    assert got[4][2:] == (9, 500_001)
