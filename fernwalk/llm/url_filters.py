"""URL filters: pattern rules indexed by their rarest literal token.

A URL is cut into its alphanumeric tokens; each token fetches the rules indexed
under it, and only those run their regular expressions. Which of a rule's tokens
is the rarest is counted over all URLs of the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwalk.llm.common import LOWER, UPPER, ascii_lower, checked_broadcast, map_columns

TOKEN = re.compile(r"[a-z0-9]+")
_FOLD = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class HostRule:
    """``action`` for a host, its subdomains and every path that starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``action`` for URLs that hold ``pattern``, in lower case.

    ``*`` stands for any run of characters, ``^`` for one character that is no
    letter or digit, or for an end of the URL. All else is literal.
    """

    action: str
    pattern: str

    def regex(self) -> str:
        return "".join({"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}.get(c, re.escape(c)) for c in self.pattern)

    def parts(self) -> tuple[re.Pattern, ...]:
        """What stands between the ``*``, in order. Each is looked for behind the one before, so no text is read twice."""
        return tuple(re.compile(PatternRule(self.action, x).regex(), re.DOTALL) for x in self.pattern.split("*") if x)

    def tokens(self) -> list[str]:
        """Literal tokens that stand as whole tokens in every URL that matches."""
        out = []
        for m in TOKEN.finditer(self.pattern):
            before, after = self.pattern[: m.start()][-1:], self.pattern[m.end() :][:1]
            if before not in ("", "*") and after not in ("", "*"):
                out.append(m[0])
        return out


#: The rules of the contract.
HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
#: Rules of the method for what no host rule decides. An allow rule beats a block rule. Another list comes from a table by ``rules_of``.
PATTERN_RULES = tuple(
    PatternRule(action, pattern)
    for action, patterns in {
        "block": "^ads^ ^adserver^ ^adclick^ ^doubleclick^ ^popunder^ /banner/*.gif^ /banners/*^ ^tracker^ ^clicktrack^ ?utm_pop= "
        "^casino^ ^online-casino^ ^poker^ ^free-bets^ ^betting^ ^slots^ ^lottery-win^ ^pills^ ^viagra^ ^payday-loan^ ^replica-watches^ "
        "^spam^ ^linkfarm^ ^phishing^ ^malware^ ^warez^ ^keygen^ ^porn^ ^xxx^ ^adult^ ^escort^",
        "allow": "/responsible-gambling/* ^anti-spam^ ^adult-education^ /security/*^phishing^ /security/*^malware^",
    }.items()
    for pattern in patterns.split()
)
#: Rules that a table may hold; they are the setting of a run, and each task holds them.
MOST_RULES = 1_000_000


def rules_of(table: DataFrame) -> tuple[PatternRule, ...]:
    """The distinct rules of ``table(action, pattern)``; rows with another action or without a pattern are refused."""
    rows = table.select("action", F.lower("pattern").alias("pattern")).distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    for r in rows:
        if r.action not in ("block", "allow") or not r.pattern:
            raise ValueError(f"not a rule: {r.action} {r.pattern}")
    return tuple(sorted((PatternRule(*r) for r in rows), key=lambda r: (r.pattern, r.action)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both are empty for null and for a URL without ``://``."""
    rest = (url or "").partition("://")[2]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_FOLD), tail[:stop]


def host_rule(host: str, path: str, rules: dict[str, list[HostRule]]) -> HostRule | None:
    """The rule with the longest name among those that fit; ``rules`` are keyed by host."""
    found, at = [], host
    while at:
        found += [r for r in rules.get(at, ()) if path.startswith(r.path)]
        at = at.partition(".")[2]
    return max(found, key=lambda r: len(r.name), default=None)


def stands(parts: tuple[re.Pattern, ...], text: str) -> bool:
    at = 0
    for p in parts:
        m = p.search(text, at)
        if not m:
            return False
        at = m.end()
    return True


class RuleIndex:
    """Pattern rules by their rarest token. ``counts``: in how many URLs a token stands."""

    def __init__(self, rules: tuple[PatternRule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[tuple[re.Pattern, ...], str]]] = {}
        self.always: list[tuple[tuple[re.Pattern, ...], str]] = []
        for r in rules:
            entry = (r.parts(), r.action)
            if tokens := r.tokens():
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def verdict(self, url: str | None) -> str:
        text = (url or "").translate(_FOLD)
        hit = set()
        for token in set(TOKEN.findall(text)) & self.by_token.keys():
            hit.update(action for parts, action in self.by_token[token] if stands(parts, text))
        hit.update(action for parts, action in self.always if stands(parts, text))
        return "block" if hit == {"block"} else "allow"


def token_counts(urls: DataFrame, rules: tuple[PatternRule, ...], url: str = "url") -> dict[str, int]:
    """URLs that hold each token of the rules; the driver gets one number a rule token."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    known = urls.sparkSession.createDataFrame(pa.table({"token": wanted}))
    tokens = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(url)), F.lit("([a-z0-9]+)")))
    found = urls.select(F.explode(tokens).alias("token")).join(checked_broadcast(known), "token", "left_semi")
    return {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}


def judge_urls(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row for each row of ``pages``.

    A null URL and one without ``://`` have an empty host and path, so no host
    rule fits; the pattern rules still see the text of the URL. Repeated rows are
    judged alike, null ids stay, other columns are ignored, and an empty table
    gives an empty result.
    Very long URLs are judged whole.
    """
    counts = token_counts(pages, pattern_rules, url_col)
    by_host: dict[str, list[HostRule]] = {}
    for r in host_rules:
        by_host.setdefault(r.host, []).append(r)

    def start():
        index = RuleIndex(pattern_rules, counts)

        def work(rows):
            out = {k: [] for k in (id_col, "host", "path", "rule", "verdict")}
            out[id_col] = rows[id_col]
            for url in rows[url_col]:
                host, path = split_url(url)
                rule = host_rule(host, path, by_host)
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(rule.name if rule else None)
                out["verdict"].append(rule.action if rule else index.verdict(url))
            return out

        return work

    kind = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(id_col, url_col)
    return map_columns(narrow, start, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
