"""Secret scans: assignment-aware lexing of source and configuration text.

Base patterns find well-known shapes. Beside them, texts are lexed into
name-literal pairs: assignments of source code, subscripts, typed names, pointers and
tuples among them, defaults, lists, maps and arguments of calls, defines, keys of
JSON and YAML with its blocks, elements of XML. Names that are written without
separators are split by a lexicon. Constants are
propagated through names and concatenations in the order of the text, and each
literal is scored by the sensitivity of the name that it reaches and by its own
strength.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwalk.llm.common import map_columns, rewrite_text

#: The patterns of the contract: kind, pattern, its group to measure, least length, literals one of which each match holds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 or more are the matches of ``[0-9a-f]+`` that are long enough.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "literal")

#: Tokens but for strings, which begin at a quote: line ends, joined lines, references, operators, brackets, bare words.
_LEX = re.compile(r"\\\n|\n|\"\"\"|'''|[\"']|\$\{\w+\}|:=|=>|\?\?=|\|\|=|\?=|\?\?|\|\||->|<-|\+=|[=!<>]=|[:=+()\[\]]|[^\s\"':=+,;(){}\[\]<>|]+|[^\s]")
_CLOSE = {q: re.compile(rf"(?:[^{q}\\\n]++|\\.)*+{q}") for q in "\"'"}
#: The rest of a YAML line whose value is the block below.
_BLOCK = re.compile(r"\x20*[|>][-+0-9]*\x20*(?:\n|\Z)")
_XML = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>")
_XML_PAIR = re.compile(r"\b(?:key|name)\s*=\s*\"([^\"<>]*)\"\s+value\s*=\s*\"([^\"<>]*)\"", re.I)
#: A part of each sensitive name; a text without any holds no secret of the method.
_MAYBE = re.compile(r"passw|pwd|passphrase|secret|token|apikey|credential|bearer|pass|auth|key|string", re.I)
#: What gives names values at all.
_ASSIGNS = re.compile(r"[=:]|</|->|<-|\([^()]*[\"']|define|setenv|export|\bset\b")
_NAME = re.compile(r"[A-Za-z_$][\w.$-]*")
_REFERENCE = re.compile(r"\$(?:(\w+)|\{(\w+)\})")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PLACEHOLDER = re.compile(r"(?i)change.?me|(?:^|[\W_])example(?:$|[\W_])|placeholder|your[_-]|dummy|redacted|x{4,}|\*{3,}|^\$|^<|^%")

#: Parts of a name and how sensitive they make it; pairs must both be there.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "pass": 0.8, "auth": 0.7}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("signing", "key"): 1.0, ("encryption", "key"): 1.0, ("client", "key"): 0.8, ("connection", "string"): 0.8}
#: Words that stand beside sensitive ones in names written without separators.
BESIDE = frozenset(
    "access account admin app aws azure client cloud code current database db default dev encryption ftp git github gcp id jwt key keys list local login mail main master mongo my mysql"
    " new oauth old pg postgres private prod production public redis refresh remote root server service session set sign signing site smtp ssh staging store str string test text user usr val value values web".split()
)
#: Sensitive words so long are told at the end of a longer word whatever comes before them.
TELLING = 6
#: Before a string, what makes it one of another kind.
STRING_PREFIXES = frozenset(("b", "f", "r", "u", "l", "br", "rb", "fr", "rf", "u8"))
#: Words that give a name a value without an operator.
DEFINES = frozenset(("#define", "define", "setenv", "export", "set", "DEFINE"))
ASSIGNS = frozenset(("=", ":", ":=", "=>", "+=", "?=", "||=", "??=", "->", "<-"))
#: Between alternatives, of which each may be the value.
ELSE = frozenset(("or", "||", "??"))
#: A literal of this score or more is a secret.
THRESHOLD = 0.5


#: Literals of this length aren't stronger for being longer.
FULL = 12
#: Literals of fewer characters are too weak to be told from words; with 0 every literal of a sensitive name is taken.
LEAST = 8


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    value_start: int


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that are too short are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [Span("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [Span("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return out


@lru_cache(maxsize=65536)
def words_in(part: str) -> tuple[str, ...]:
    """The words of a part of a name: itself, or those of the lexicon that it is made of, one of them sensitive."""
    if part in SENSITIVE or part in BESIDE or len(part) > 64:
        return (part,)
    known = BESIDE.union(SENSITIVE, (f"{w}s" for w in SENSITIVE))
    cut: list[tuple[str, ...] | None] = [(), *([None] * len(part))]
    for end in range(1, len(part) + 1):
        cut[end] = next(((*cut[at], part[at:end]) for at in range(max(0, end - 16), end) if cut[at] is not None and part[at:end] in known), None)
    found = cut[len(part)] or next(((w,) for w in SENSITIVE if len(w) >= TELLING and part.endswith((w, f"{w}s"))), (part,))
    return tuple(w if w in SENSITIVE or w in BESIDE else w.removesuffix("s") if w.removesuffix("s") in SENSITIVE else w for w in found)


@lru_cache(maxsize=65536)
def name_score(name: str) -> float:
    parts = {w for p in _PARTS.findall(name) for w in words_in(p.lower())}
    return max(
        max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0),
        max((s for pair, s in SENSITIVE_PAIRS.items() if parts.issuperset(pair)), default=0.0),
    )


class Term(NamedTuple):
    """A part of what is assigned: a literal or a name, and where its text stands."""

    kind: str
    text: str
    start: int
    end: int
    quoted: bool


Pair = tuple[str, list[Term]]


class Value:
    """Literals put together: a literal, or values side by side, which are shared and never copied."""

    __slots__ = ("chars", "parts", "quoted", "term", "told", "weak")

    def __init__(self, term: Term | None, parts: tuple[Value, ...] = ()):
        self.term, self.parts, self.told = term, parts, False
        if term:
            self.chars, self.quoted, self.weak = Counter(term.text), term.quoted, bool(_PLACEHOLDER.search(term.text))
        else:
            self.chars = Counter()
            for p in parts:
                self.chars.update(p.chars)
            self.quoted, self.weak = any(p.quoted for p in parts), any(p.weak for p in parts)

    def strength(self, least: int = LEAST) -> float:
        """By length, entropy, and whether letters and digits mix; nothing that reads like a placeholder."""
        n = sum(self.chars.values())
        if least == 0:
            return float(n > 0)
        if n < least or self.weak:
            return 0.0
        bits = -sum(c / n * math.log2(c / n) for c in self.chars.values())
        mixed = any(c.isdigit() for c in self.chars) and any(c.isalpha() for c in self.chars)
        if not mixed and (not self.quoted or " " in self.chars):
            return 0.0
        return min(1.0, bits / 3.0) * min(1.0, n / FULL) * (1.0 if mixed else 0.6)

    def tell(self, found: list[Span]) -> None:
        """Adds the spans of all literals that weren't told before."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                todo += v.parts
                if v.term and v.term.end > v.term.start:
                    found.append(Span("literal", v.term.start, v.term.end, v.term.start))


def lex(text: str) -> list[Term]:
    """Tokens of the whole text; the kind is ``op``, ``word``, ``string``, or ``triple`` for quotes that may begin a long string."""
    out: list[Term] = []
    at, n = 0, len(text)
    # A quote that isn't closed on its line closes none of the line's later ones either.
    open_until = {'"': -1, "'": -1}
    while at < n and (m := _LEX.search(text, at)):
        word, start, at = m[0], m.start(), m.end()
        if word == "\\\n":
            continue
        if word in ('"', "'"):
            if start >= open_until[word]:
                if close := _CLOSE[word].match(text, at):
                    out.append(Term("string", text[at : close.end() - 1], at, close.end() - 1, True))
                    at = close.end()
                    continue
                end = text.find("\n", at)
                open_until[word] = n if end < 0 else end
            out.append(Term("op", word, start, at, False))
        elif word in ('"""', "'''"):
            out.append(Term("triple", word, start, at, False))
        elif len(word) > 1 and word not in OPERATORS or word.isalnum() or word in "_$/":
            out.append(Term("word", word, start, at, False))
        else:
            out.append(Term("op", word, start, at, False))
    return out


OPERATORS = ASSIGNS | ELSE - {"or"} | {"==", "!=", "<=", ">="}


def opaque(text: str) -> bool:
    """Whether a literal among others, in a list, map or call, is one that names nothing: no words, no address."""
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and not any(c.isspace() for c in text) and "://" not in text


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens = text, lex(text)
        self.unclosed: set[str] = set()
        # The strings that stand directly in each bracket, but for the keys of maps, and where it closes.
        self.inside: dict[int, list[Term]] = {}
        self.closes: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in "([{":
                open_.append(i)
                self.inside[i] = []
            elif t.kind == "op" and t.text in ")]}" and open_:
                self.closes[open_.pop()] = i
            elif t.kind == "string" and open_ and not (i + 1 < len(self.tokens) and self.tokens[i + 1].text in (":", "=>", "=")):
                self.inside[open_[-1]].append(Term("literal", t.text, t.start, t.end, True))

    def target(self, i: int) -> str | None:
        """The name that token ``i`` ends: a word, also of a pointer or an array, a quoted key, or a subscript by a quoted key."""
        if i >= 2 and self.tokens[i].text == "]" and self.tokens[i - 1].text == "[":
            i -= 2
        elif i >= 3 and self.tokens[i].text == "]" and self.tokens[i - 1].text.isdigit() and self.tokens[i - 2].text == "[":
            i -= 3
        if i >= 0 and self.tokens[i].text == "]" and i >= 2 and self.tokens[i - 1].kind == "string" and self.tokens[i - 2].text == "[":
            i -= 1
        if i < 0 or self.tokens[i].kind not in ("word", "string"):
            return None
        name = self.tokens[i].text.lstrip("*&@").rstrip("?")
        return name if _NAME.fullmatch(name) else None

    def targets(self, i: int) -> list[str]:
        """The names before token ``i``, in their order, that are parted by commas, if there are several."""
        names = []
        while (name := self.target(i)) and self.tokens[i].kind == "word":
            names.append(name)
            if i < 2 or self.tokens[i - 1].text != ",":
                return names[::-1] if len(names) > 1 else []
            i -= 2
        return []

    def block(self, i: int) -> tuple[Term | None, int]:
        """The lines below a YAML key that are indented deeper, if operator ``i`` begins such a block, and the token after them."""
        op, text = self.tokens[i], self.text
        m = _BLOCK.match(text, op.end) if op.text == ":" else None
        if not m:
            return None, i
        line = text.rfind("\n", 0, op.start) + 1
        depth = len(text[line : op.start]) - len(text[line : op.start].lstrip(" -"))
        at, first, last, kept = m.end(), -1, -1, []
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            row = text[at:end]
            if row.strip():
                if len(row) - len(row.lstrip(" ")) <= depth:
                    break
                kept.append(row.strip())
                first = at + len(row) - len(row.lstrip()) if first < 0 else first
                last = at + len(row.rstrip())
            at = end + 1
        while i < len(self.tokens) and self.tokens[i].start < at:
            i += 1
        return (Term("literal", "".join(kept), first, last, True) if kept else None), i

    def term(self, i: int) -> tuple[Term | None, int]:
        """The term that begins at token ``i``, and the token after it."""
        t = self.tokens[i]
        if t.kind == "string":
            return Term("literal", t.text, t.start, t.end, True), i + 1
        if t.kind == "triple":
            end = -1 if t.text in self.unclosed else self.text.find(t.text, t.end)
            if end < 0:
                self.unclosed.add(t.text)
                return None, i + 1
            i += 1
            while i < len(self.tokens) and self.tokens[i].start < end + 3:
                i += 1
            return Term("literal", self.text[t.end : end], t.end, end, True), i
        if t.kind != "word" or not re.match(r"[\w$/]", t.text):
            return None, i
        if t.text.lower() in STRING_PREFIXES and i + 1 < len(self.tokens) and self.tokens[i + 1].kind in ("string", "triple"):
            if self.tokens[i + 1].start - (self.tokens[i + 1].kind == "string") == t.end:
                return self.term(i + 1)
        if i + 3 < len(self.tokens) and self.tokens[i + 1].text == "[" and self.tokens[i + 3].text == "]" and self.tokens[i + 2].kind == "string":
            return Term("name", self.tokens[i + 2].text, t.start, self.tokens[i + 3].end, False), i + 4
        return Term("name" if _NAME.fullmatch(t.text) or _REFERENCE.fullmatch(t.text) else "literal", t.text, t.start, t.end, False), i + 1

    def terms(self, i: int) -> tuple[list[Term], int]:
        """Terms from token ``i`` on that are joined by ``+`` or by standing side by side as strings, through brackets and line ends within."""
        out: list[Term] = []
        tokens, depth, plus = self.tokens, 0, True
        while i < len(tokens):
            word, kind = tokens[i].text, tokens[i].kind
            if kind == "op":
                if word == "(" and plus:
                    depth += 1
                elif word == ")" and depth:
                    depth -= 1
                elif word == "+" and out and not plus:
                    plus = True
                elif word != "\n" or not depth and not (plus and out):
                    break
                i += 1
                continue
            if not plus and not (out[-1].quoted and kind in ("string", "triple")):
                break
            found, after = self.term(i)
            if found is None:
                break
            out.append(found)
            i, plus = after, False
        return out, i

    def text_at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def values(self, i: int) -> tuple[list[list[Term]], int]:
        """What may be assigned by what begins at token ``i``, each as its terms: a value, its alternatives, the literals of a list, map or call."""
        out: list[list[Term]] = []
        while True:
            terms, after = self.terms(i)
            opens = after if terms and terms[-1].kind == "name" and self.text_at(after) == "(" else i if not terms and self.text_at(i) in ("[", "{") else -1
            if opens >= 0 and opens in self.closes:
                out += [[t] for t in self.inside[opens] if opaque(t.text)]
                out += [terms[:-1]] if len(terms) > 1 else []
                # What stands within is looked at for pairs of its own.
                end = self.closes[opens] + 1
                after = max(after, opens)
            else:
                out += [terms] if terms else []
                end = after
            if self.text_at(end) not in ELSE:
                return out, after
            i = end + 1

    def call(self, i: int) -> list[Pair]:
        """Pairs of the call whose bracket is token ``i``: the callee and its arguments, or a first argument that is a name and those after it."""
        literals, callee = self.inside.get(i, []), self.target(i - 1) if i and self.tokens[i - 1].kind == "word" else None
        if not callee or not literals:
            return []
        out = [(callee, [t]) for t in literals if name_score(callee) and opaque(t.text)]
        if len(literals) > 1 and _NAME.fullmatch(literals[0].text) and name_score(literals[0].text):
            out += [(literals[0].text, [t]) for t in literals[1:] if opaque(t.text)]
        return out

    def pairs(self) -> list[Pair]:
        """Names and the terms assigned to them, in the order of the text."""
        out: list[Pair] = []
        tokens, i = self.tokens, 0
        while i < len(tokens):
            op = tokens[i]
            if op.kind == "op" and op.text == "(":
                out += self.call(i)
            elif op.kind == "word" and op.text in DEFINES and i + 2 < len(tokens) and tokens[i + 1].kind == "word" and tokens[i + 2].kind in ("string", "word") and (name := self.target(i + 1)):
                terms, after = self.terms(i + 2)
                if terms and self.text_at(after) in ("", "\n", ";"):
                    out.append((name, terms))
            if op.kind != "op" or op.text not in ASSIGNS:
                i += 1
                continue
            if op.text in ("=", ":=") and self.text_at(i - 2) == "," and (names := self.targets(i - 1)):
                given, at = [], i + 1
                while len(given) < len(names):
                    terms, at = self.terms(at)
                    given.append(terms)
                    if self.text_at(at) != ",":
                        break
                    at += 1
                if len(given) == len(names) and all(given):
                    out += zip(names, given, strict=True)
                    i = max(at, i + 1)
                    continue
            name = self.target(i - 1)
            held, after = self.block(i)
            if held:
                terms, i = [held], after
            else:
                given, after = self.values(i + 1)
                # A type between the name and what is assigned: NAME: TYPE = VALUE.
                if op.text == ":" and len(given) == 1 and len(given[0]) == 1 and given[0][0].kind == "name" and after < len(tokens) and tokens[after].text == "=":
                    given, after = self.values(after + 1)
                i = max(after, i + 1)
                terms = given[0] if given else []
                if name:
                    out += [(name, more) for more in given[1:]]
            if name and terms:
                if op.text == "+=":
                    terms = [Term("name", name, op.start, op.start, False), *terms]
                out.append((name, terms))
        return out


def assignments(text: str) -> list[Pair]:
    """Name-literal pairs of source code and of configuration, XML among it, in the order of the text."""
    out = _Parser(text).pairs()
    if "<" in text and ">" in text:
        for pattern in (_XML, _XML_PAIR):
            for m in pattern.finditer(text):
                inner = m[2].strip()
                if inner and _NAME.fullmatch(m[1]):
                    start = m.start(2) + len(m[2]) - len(m[2].lstrip())
                    out.append((m[1], [Term("literal", inner, start, start + len(inner), True)]))
        out.sort(key=lambda pair: pair[1][-1].start)
    return out


Key = tuple[str, bool]


def referred(term: Term) -> Key | None:
    """The name that a term stands for and whether it is written as a reference: NAME, $NAME, ${NAME} or one of the latter in quotes."""
    if m := _REFERENCE.fullmatch(term.text):
        return m[1] or m[2], True
    return (term.text, False) if term.kind == "name" else None


def constants(pairs: list[Pair]) -> dict[Key, Value]:
    """The values that names stand for somewhere in the text, for uses that come before the names are set.

    A name's constant is its first assignment that leads to literals alone, through
    names and concatenations of any depth.
    """
    given: dict[str, list[list[Term]]] = {}
    for name, terms in pairs:
        given.setdefault(name, []).append(terms)
    known: dict[Key, Value | None] = {}
    for wanted in {k for name, terms in pairs if name_score(name) for t in terms if (k := referred(t)) and k[0] in given}:
        # Depth first without recursion; a key that is being resolved is in the stack once.
        stack, busy = [(wanted, _needs(wanted, given))], {wanted}
        while stack:
            key, needs = stack[-1]
            if key not in known and (first := next((k for k in needs if k not in known and k not in busy), None)):
                stack.append((first, _needs(first, given)))
                busy.add(first)
                continue
            if key not in known:
                known[key] = next((x for terms in given[key[0]] if (x := joined(terms, key[1], known.get))), None)
            busy.discard(stack.pop()[0])
    return {k: v for k, v in known.items() if v}


def _needs(key: Key, given: dict[str, list[list[Term]]]) -> Iterator[Key]:
    return (k for terms in given[key[0]] for t in terms if (k := _next(t, key[1])) and k[0] in given)


def _next(term: Term, reference: bool) -> Key | None:
    to = referred(term)
    return to and (to[0], to[1] or reference)


def joined(terms: list[Term], reference: bool, value: Callable[[Key], Value | None], loose: bool = False) -> Value | None:
    """The value that the terms make up, None if one of them isn't known.

    Unquoted words are literals only where a reference leads to them; elsewhere they
    are names. ``loose`` takes them, and unknown names, by their own text.
    """
    parts = []
    for term in terms:
        to = _next(term, reference)
        if to and (held := value(to)):
            parts.append(held)
        elif loose or not _REFERENCE.fullmatch(term.text) and (term.quoted or reference):
            parts.append(Value(term))
        else:
            return None
    return parts[0] if len(parts) == 1 else Value(None, tuple(parts))


def literal_spans(text: str, least: int = LEAST) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants.

    A name stands for what was last assigned to it before the place where it is
    used; if nothing known was, for its first constant in the rest of the text.
    """
    if not _ASSIGNS.search(text) or not _MAYBE.search(text):
        return []
    pairs = assignments(text)
    if not any(name_score(name) for name, _ in pairs):
        return []
    ahead = constants(pairs)
    now: dict[Key, Value] = {}
    found: list[Span] = []
    for name, terms in pairs:
        if sensitive := name_score(name):
            value = joined(terms, False, lambda key: now.get(key) or ahead.get(key), loose=True)
            if sensitive * value.strength(least) >= THRESHOLD:
                value.tell(found)
        for reference in (False, True):
            if held := joined(terms, reference, now.get):
                now[name, reference] = held
    return list(dict.fromkeys(found))


def scan_text(text: str | None, least: int = LEAST) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: a literal inside a base span isn't told again."""
    text = text or ""
    key = lambda s: (s.start, KINDS.index(s.kind), s.end)
    base = sorted(base_spans(text), key=key)
    more, at, reach = [], 0, -1
    for s in sorted(literal_spans(text, least), key=key):
        while at < len(base) and base[at].start <= s.start:
            reach = max(reach, base[at].end)
            at += 1
        if s.end > reach:
            more.append(s)
    return base, sorted(base + more, key=key)


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with the value of each span replaced; touching values become one mark."""
    if not text:
        return text
    out, at = [], 0
    for s in sorted(scan_text(text)[1], key=lambda s: (s.value_start, s.end)):
        if s.end <= at:
            continue
        if s.value_start >= at:
            out += [text[at : s.value_start], mark]
        at = s.end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_spans, spans, n_literal)``, one row for each row of ``docs``.

    Spans are ``kind:start:end`` in code points. Literals of fewer than ``least``
    characters are left out; with 0 all that reach a sensitive name are told,
    however weak. A null or empty text has none.
    Repeated rows and null ids stay, other columns are ignored, and an empty table
    gives an empty result.
    Very long texts are scanned whole.
    """

    def start():
        def work(rows):
            out = {k: [] for k in (id_col, "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_literal")}
            out[id_col] = rows[id_col]
            for text in rows[text_col]:
                base, spans = scan_text(text, least)
                for k in ("assign", "access", "hex"):
                    out[f"n_{k}"].append(sum(s.kind == k for s in base))
                out["base_spans"].append(as_text(base))
                out["spans"].append(as_text(spans))
                out["n_literal"].append(len(spans) - len(base))
            return out

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(
        docs.select(id_col, text_col),
        start,
        f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_literal long",
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets in its texts replaced, and the number of characters, if it is there, counted anew."""
    out = rewrite_text(docs, text_col, lambda: lambda texts: [redact(t) for t in texts])
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out
