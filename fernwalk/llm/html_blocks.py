"""HTML cut into its leaf blocks: text between block-level tags, with the path of open elements.

The scanner reads a page once. Whatever is looked for ahead and isn't there is
remembered, each element is opened and closed once, and a path is a set of hashed
places that grows by its own element, so broken and deep pages cost no more than
others of their size.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

#: Places of the hashed path.
PATH_DIMS = 512
_START = re.compile(r"[a-zA-Z][^\s/>]*")
#: What decides where a tag ends: its end, or a value in quotes.
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
#: Elements whose content isn't markup and never text of the page: only their end tag ends them.
RAW = frozenset("script style textarea title iframe xmp noembed".split())
#: Of these the rest of a page is, if they aren't closed; the others are then passed over.
TO_THE_END = frozenset("script style".split())
#: Content that is no text: controls, drawings, sources of formulas, and parts that aren't shown.
MUTED = frozenset("button select svg template annotation annotation-xml datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr link meta "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new element of these ends an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Those open a scope that the rule above doesn't look beyond.
SCOPES = frozenset("body ul ol dl table div article section main aside nav header footer form td th blockquote figure fieldset".split())
#: Beginning one of these ends an open paragraph, and what is muted and wasn't closed.
ENDS_P = SCOPES | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address details li dt dd tr".split())
_ENDABLE = frozenset(x for group in CLOSES.values() for x in group)
_NOTHING: frozenset[str] = frozenset()


@dataclass(slots=True)
class Block:
    """``places``: the hashed path, a bit for each place; ``depth``: how many elements are open."""

    places: int
    depth: int
    text: str
    link_chars: int


@lru_cache(maxsize=65536)
def name_places(name: str) -> int:
    """Places of an element anywhere in a path: its tag, and the words of its class, id and role."""
    tag, *words = name.split(".")
    out = 1 << zlib.crc32(f"t {tag}".encode("utf-8", "surrogatepass")) % PATH_DIMS
    for w in words:
        out |= 1 << zlib.crc32(f"c {w}".encode()) % PATH_DIMS
    return out


@lru_cache(maxsize=65536)
def near_places(*tags: str) -> int:
    """Places of a path's last elements, the last first, by their distance."""
    out = 0
    for far, tag in enumerate(tags):
        out |= 1 << zlib.crc32(f"{far} {tag}".encode("utf-8", "surrogatepass")) % PATH_DIMS
    return out


def _name(tag: str, attrs: str) -> str:
    """The tag, with the words of its class, id and role."""
    if "=" not in attrs:
        return tag
    words = [w for m in _ATTR.finditer(attrs) for w in _TOKEN.findall((m[1] or m[2] or m[3] or "").lower())]
    return f"{tag}.{'.'.join(words)}" if words else tag


def clean(raw: str) -> str:
    """Character references decoded, white space made one space, trimmed."""
    return " ".join((html.unescape(raw) if "&" in raw else raw).split())


class _Scanner:
    def __init__(self, page: str):
        self.page, self.out = page, []
        #: Open elements: tag, and the places of the path down to it.
        self.stack: list[tuple[str, int]] = []
        self.count: dict[str, int] = {}
        #: For each open scope, how many elements that others end are open in it.
        self.scopes: list[dict[str, int]] = [{}]
        self.parts: list[str] = []
        self.linked, self.in_link, self.places = 0, False, 0
        #: What doesn't occur any more.
        self.missing: set[str] = set()
        self.last_end = page.rfind(">")

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def find_end_tag(self, tag: str, at: int) -> int:
        """Where the next end tag of that name begins."""
        key = f"</{tag}"
        if key in self.missing:
            return -1
        page, size = self.page, len(key)
        while (at := page.find("</", at)) >= 0:
            name = page[at + 2 : at + size]
            if name.isascii() and name.lower() == tag and page[at + size : at + size + 1] in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
                return at
            at += 2
        self.missing.add(key)
        return -1

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends, its ``>``; there is one."""
        first, page = -1, self.page
        while m := _STOP.search(page, at):
            if not m[1]:
                return m.start()
            if first < 0:
                first = page.find(">", m.end())
            close = self.find(m[1], m.end())
            if close < 0 or close > self.last_end:
                return first
            at = close + 1
        return first if first >= 0 else page.find(">", at)

    def flush(self) -> None:
        if self.parts:
            if text := clean("".join(self.parts)):
                self.out.append(Block(self.places, len(self.stack), text, min(self.linked, len(text))))
            self.parts.clear()
        self.linked, self.in_link = 0, False

    def push(self, tag: str, name: str) -> None:
        above = self.stack[-1][1] if self.stack else 0
        self.stack.append((tag, above | name_places(name)))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in _ENDABLE:
            held = self.scopes[-1]
            held[tag] = held.get(tag, 0) + 1
        if tag in SCOPES:
            self.scopes.append({})

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.count[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
        if tag in _ENDABLE:
            self.scopes[-1][tag] -= 1
        return tag

    def placed(self) -> None:
        near = [x[0] for x in self.stack[-1:-4:-1]]
        self.places = (self.stack[-1][1] | near_places(*near)) if near else 0

    def block_tag(self, tag: str, closing: bool, attrs: str) -> None:
        self.flush()
        if closing:
            if self.count.get(tag):
                while self.pop() != tag:
                    pass
        elif tag not in VOID:
            ended = CLOSES.get(tag, _NOTHING) | ({"p"} if tag in ENDS_P else _NOTHING)
            if any(self.scopes[-1].get(x) for x in ended):
                while self.pop() not in ended:
                    pass
            self.push(tag, _name(tag, attrs))
        self.placed()

    def run(self) -> list[Block]:
        page, at, n = self.page, 0, len(self.page)
        muted, deep = "", 0
        while at < n:
            open_ = self.find("<", at)
            stop = open_ if open_ >= 0 else n
            if stop > at and not muted:
                self.parts.append(raw := page[at:stop])
                if self.in_link:
                    self.linked += len(raw.strip())
            if open_ < 0:
                break
            at = open_ + 1
            if at > self.last_end:
                # No tag ends from here on, so this begins none; a tag that is cut off isn't text.
                if not muted and not _START.match(page, at + (page[at : at + 1] == "/")) and page[at : at + 1] not in ("!", "?"):
                    self.parts.append("<")
                    continue
                break
            if page.startswith("!--", at):
                end = self.find("-->", at + 1)
                at = end + 3 if end >= 0 else page.find(">", at) + 1
                continue
            if page[at] in "!?":
                at = page.find(">", at) + 1
                continue
            closing = page[at] == "/"
            m = _START.match(page, at + closing)
            if not m:
                if closing:
                    at = page.find(">", at) + 1
                elif not muted:
                    self.parts.append("<")
                continue
            tag = m[0].lower()
            end = self.tag_end(m.end())
            attrs, at = page[m.end() : end], end + 1
            if muted:
                if tag == muted:
                    deep += -1 if closing else not attrs.endswith("/")
                    if deep:
                        continue
                    muted = ""
                    self.parts.append(" ")
                    continue
                if tag not in ENDS_P and not (closing and self.count.get(tag)) or muted == "template":
                    continue
                muted, deep = "", 0
            if tag in RAW:
                if not closing:
                    end = self.find_end_tag(tag, at)
                    if end >= 0:
                        at = page.find(">", end) + 1 or n
                    elif tag in TO_THE_END:
                        at = n
                    self.parts.append(" ")
            elif tag in MUTED:
                if not closing and not attrs.endswith("/") and (tag != "template" or self.find_end_tag(tag, at) >= 0):
                    muted, deep = tag, 1
                self.parts.append(" ")
            elif tag in INLINE:
                if tag == "a":
                    self.in_link = not closing
                elif tag == "br":
                    self.parts.append(" ")
            elif tag not in ("head", "html") or closing is False and tag == "html":
                self.block_tag(tag, closing, attrs)
        self.flush()
        return self.out


def blocks(page: str | None) -> list[Block]:
    """The blocks that hold text, in page order.

    Unclosed elements end where their parent or the page does; an unclosed control
    or drawing ends at the next block-level tag, an unclosed comment at its ``>``.
    """
    return _Scanner(page).run() if page else []
