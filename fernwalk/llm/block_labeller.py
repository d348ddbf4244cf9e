"""A bidirectional LSTM in numpy that labels the blocks of a page as article or not.

Each block is a vector of its hashed tag path, its hashed words and a few
measures of its text; the network reads the blocks of a page in both directions,
so each is judged within the whole page. It is trained on pages made from a
parameterised set of layouts, with made-up words, so no table is needed.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

from fernwalk.llm.html_blocks import PATH_DIMS, Block, blocks

WORD_DIMS, MEASURES, HIDDEN = 48, 12, 16
TRAIN_PAGES, EPOCHS, BATCH, SEED = 2400, 8, 32, 7
WEIGHTS = Path(__file__).with_name("block_weights.npz")
#: Blocks, padding included, that one step of the network holds.
STEP_BLOCKS = 4096


def path_places(places: int) -> list[int]:
    """The places that are set in a hashed path."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(places.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little")).tolist()


@lru_cache(maxsize=200_000)
def word_place(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIMS


def text_rows(page: Sequence[Block]) -> np.ndarray:
    """Hashed words and measures, a row for each block."""
    longest = max((len(b.text) for b in page), default=1)
    places: list[int] = []
    counts, measures = [], []
    for i, b in enumerate(page):
        words = b.text.lower().split()
        places += [i * WORD_DIMS + word_place(w) for w in words]
        counts.append(len(words))
        n = len(b.text)
        measures.append((
            math.log1p(n) / 6, math.log1p(len(words)) / 4, b.link_chars / n, float(b.link_chars >= n - 1),
            float(b.text[-1] in ".!?:;…\"”»"), float(n < 30), float(n > 120), i / max(1, len(page) - 1),
            n / longest, float("©" in b.text), math.log1p(b.depth) / 3, 1.0,
        ))
    hashed = np.zeros(len(page) * WORD_DIMS, np.float32)
    each = np.array([1.0 / math.sqrt(c) for c in counts])
    np.add.at(hashed, np.array(places, np.intp), np.repeat(each, counts))
    out = np.empty((len(page), WORD_DIMS + MEASURES), np.float32)
    np.minimum(hashed.reshape(-1, WORD_DIMS), 2.0, out=out[:, :WORD_DIMS])
    out[:, WORD_DIMS:] = np.array(measures, np.float32).reshape(-1, MEASURES)
    return out


@dataclass(frozen=True)
class Weights:
    """Forward and backward direction side by side: path, text, recurrence (one for each), bias; then the output."""

    path: np.ndarray
    text: np.ndarray
    back: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _recur(z: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction over ``z`` (pages, steps, 4 * HIDDEN)."""
    pages, steps, _ = z.shape
    h, c = np.zeros((pages, HIDDEN), z.dtype), np.zeros((pages, HIDDEN), z.dtype)
    out = np.empty((pages, steps, HIDDEN), z.dtype)
    for t in range(steps):
        a = z[:, t] + h @ u
        gates = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        s = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, s))
        h = o * s
        out[:, t] = h
    return out


def _recur_back(d_out: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients for the inputs and the recurrence of one direction."""
    pages, steps, _ = d_out.shape
    dz = np.empty((pages, steps, 4 * HIDDEN), d_out.dtype)
    du, dh, dc = np.zeros_like(u), np.zeros((pages, HIDDEN), d_out.dtype), np.zeros((pages, HIDDEN), d_out.dtype)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, s = keep[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - s * s)
        da = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)])
        dz[:, t] = da
        du += h.T @ da
        dh, dc = da @ u.T, dc * f
    return dz, du


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse, its padding still behind them."""
    at = np.arange(x.shape[1])[None, :]
    order = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, order[:, :, None], axis=1)


def label_pages(pages: Sequence[Sequence[Block]], w: Weights, known: dict) -> list[np.ndarray]:
    """Probabilities of the blocks of each page. ``known``: what paths add to the gates, kept between calls."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= STEP_BLOCKS:
            end += 1
        group = order[at:end]
        at = end
        lengths = np.array([len(pages[i]) for i in group])
        z = np.zeros((len(group), lengths.max(), 8 * HIDDEN), np.float32)
        for row, i in enumerate(group):
            if len(known) > 50_000:
                known.clear()
            for k, b in enumerate(pages[i]):
                if (adds := known.get(b.places)) is None:
                    known[b.places] = adds = w.path[path_places(b.places)].sum(0) + w.bias
                z[row, k] = adds
            z[row, : len(pages[i])] += text_rows(pages[i]) @ w.text
        forward = _recur(z[:, :, : 4 * HIDDEN], w.back[0])
        backward = _turned(_recur(_turned(z[:, :, 4 * HIDDEN :], lengths), w.back[1]), lengths)
        p = _sigmoid(np.concatenate([forward, backward], axis=2) @ w.out + w.out_bias)
        for row, i in enumerate(group):
            out[i] = p[row, : lengths[row]]
    return out


# Layouts that pages for training are made of.

_SYLLABLES = "ba co de fi gu ha ilo ju ka len mo na or pra qui ret sto tu vel wen xi yor zan".split()
CONTENT = ("article", "main", "div.content", "div.post", "div.entry.content", "div.article.body", "section.story", "div.main.text", "td.maincol", "div.page", "div", "main.article", "div.markdown.body", "div.c")
HEADERS = ("header", "div.header", "div.site.header", "div.masthead", "div.top.bar", "header.banner", "div.logo", "div")
NAVS = ("nav", "div.menu", "div.nav", "div.navbar", "ul.menu", "div.navigation", "div.breadcrumb", "div.pagination", "div")
NOTICES = ("div.cookie.notice", "div.consent", "div.notice", "div.alert", "div.gdpr.banner", "section.cookies", "div.paywall", "div.disclaimer")
ADS = ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.banner", "ins.adsbygoogle", "aside.ad")
SIDES = ("aside", "div.sidebar", "div.side", "div.related", "div.widget", "div.popular", "section.recommended", "div.share", "div.social", "aside.sidebar", "div.rightcol")
COMMENTS = ("section.comments", "div.comments", "div.comment.list", "ol.commentlist", "div.disqus", "div.replies", "ul.comments", "section.discussion")
FOOTERS = ("footer", "div.footer", "div.site.footer", "div.copyright", "div.legal", "footer.bottom", "div")
FORMS = ("form", "form.search", "form.newsletter", "div.subscribe", "div.signup", "form.login", "div.search", "form.comment")


class _PageMaker:
    """One page: its HTML, with the article's text marked, so that its blocks can be labelled."""

    MARK = "⁣"

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.made: list[str] = []
        #: Some pages are odd: shouted, or full of signs, bars or repeats. That doesn't make them clutter.
        r = self.r
        styles = (None, None, None, None, lambda w: w.upper() + "!!", lambda w: w + r.choice(("###", "***", "$$$")), lambda w: w + " |", lambda w: f"{w} {w} {w}", lambda w: w)
        self.odd = r.choice(styles)
        self.style = None

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def sentence(self, least: int, most: int) -> str:
        s = self.words(least, most).capitalize() + self.r.choice("....?!")
        if self.style is None:
            return s
        return " ".join(self.style(w) for w in s.split())

    def open(self, name: str) -> str:
        tag, *words = name.split(".")
        if words:
            self.made.append(f"<{tag} {self.r.choice(('class', 'class', 'id'))}=\"{self.r.choice('- _').join(words) if self.r.random() < 0.7 else '-'.join(words)}\">")
        else:
            self.made.append(f"<{tag}>")
        return f"</{tag}>"

    def links(self, n: int) -> None:
        if self.r.random() < 0.7:
            self.made.append("<ul>" + "".join(f"<li><a href='/{self.word()}'>{self.words(1, 3)}</a></li>" for _ in range(n)) + "</ul>")
        else:
            self.made.append(self.r.choice((" | ", " ", " &middot; ")).join(f"<a href='/{self.word()}'>{self.words(1, 2)}</a>" for _ in range(n)))

    def text(self, kind: str, least: int, most: int, mark: bool) -> None:
        r = self.r
        self.style = self.odd if mark or r.random() < 0.3 else None
        s = self.sentence(least, most)
        for _ in range(self.r.choice((0, 0, 1, 2, 4)) if most > 12 else 0):
            s += " " + self.sentence(3, 25)
        if most > 12 and self.r.random() < 0.2:
            s += f" <a href='#'>{self.words(1, 3)}</a> {self.sentence(2, 8)}"
        if self.r.random() < 0.1:
            s = "<b>" + s + ("</b>" if self.r.random() < 0.6 else "")
        if self.r.random() < 0.06:
            s += "<br>"
        self.style = None
        self.made.append(f"<{kind}>{self.MARK * mark}{s}</{kind}>")

    def clutter(self, kind: str) -> None:
        r = self.r
        name = r.choice({"header": HEADERS, "nav": NAVS, "notice": NOTICES, "ad": ADS, "side": SIDES, "comments": COMMENTS, "footer": FOOTERS, "form": FORMS}[kind])
        end = self.open(name)
        if kind == "header":
            self.made.append(f"<{(k := r.choice(('div', 'h1', 'h2', 'p')))}>{self.words(1, 4)}</{k}>")
            if r.random() < 0.6:
                self.links(r.randint(2, 7))
        elif kind == "nav":
            self.links(r.randint(3, 12))
        elif kind == "notice":
            self.text(r.choice(("p", "div", "noscript")), 5, 25, False)
        elif kind == "ad":
            self.made.append(self.sentence(2, 14)) if r.random() < 0.6 else self.text("p", 3, 15, False)
        elif kind == "side":
            self.made.append(f"<h3>{self.words(1, 3)}</h3>")
            if r.random() < 0.6:
                self.links(r.randint(2, 6))
            else:
                for _ in range(r.randint(1, 3)):
                    self.text("p", 3, 20, False)
        elif kind == "comments":
            self.made.append(f"<h{(k := r.randint(2, 4))}>{self.words(1, 3)}</h{k}>" if r.random() < 0.7 else "")
            for _ in range(r.randint(1, 6)):
                inner = self.open(r.choice(("div.comment", "li", "div.reply", "article.comment", "div", "p")))
                self.made.append(f"<span>{self.word()}</span> " if r.random() < 0.5 else "")
                for _ in range(r.choice((1, 1, 1, 2, 3))):
                    self.text(r.choice(("p", "div")), 2, 40, False)
                self.made.append(inner)
        elif kind == "footer":
            self.made.append(r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentence(2, 8)}", f"<p>© 2020 {self.words(1, 4)}</p>", self.sentence(3, 10))))
            if r.random() < 0.5:
                self.links(r.randint(2, 6))
        else:
            self.made.append(f"<label>{self.words(1, 3)}</label><input name='q'><button>{self.word()}</button>")
            if r.random() < 0.5:
                self.text("p", 3, 14, False)
        self.made.append(end)

    def article(self) -> None:
        r = self.r
        around = (["div.wrapper"] if r.random() < 0.2 else []) + [r.choice(CONTENT)] + (["div"] if r.random() < 0.2 else [])
        # Some articles stand in the body itself, some in parts for readers without scripts.
        ends = [self.open(x) for x in ([] if r.random() < 0.12 else ["noscript", *around] if r.random() < 0.02 else ["object"] if r.random() < 0.01 else around)]
        if r.random() < 0.85:
            # The article's own header holds its title, which stays.
            top = self.open(r.choice(("header", "div.title", "div.entry.header", "hgroup"))) if r.random() < 0.2 else ""
            self.text(r.choice(("h1", "h1", "h2")), 1, 10, True)
            if r.random() < 0.15:
                self.text(r.choice(("p", "div", "h2")), 2, 12, True)
            self.made.append(top)
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 12, 20))):
            x = r.random()
            if x < 0.72:
                self.text("p", 1, r.choice((3, 12, 40)), True)
            elif x < 0.79:
                self.text(r.choice(("h2", "h3")), 1, 6, True)
            elif x < 0.85:
                self.made.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.text("li", 1, 14, True)
                self.made.append("</ul>")
            elif x < 0.88:
                self.text("blockquote", 4, 30, True)
            elif x < 0.89:
                self.text("pre", 2, 12, True)
            elif x < 0.90:
                inner = self.open("figure")
                self.text("figcaption", 2, 12, True)
                self.made.append(inner)
            elif x < 0.92:
                self.made.append("<table><tr>")
                for _ in range(3):
                    self.text("td", 1, 4, True)
                self.made.append("</tr></table>")
            else:
                self.clutter(r.choice(("ad", "ad", "side", "form", "notice")))
        for kind, chance in (("side", 0.1), ("form", 0.06), ("comments", 0.12), ("nav", 0.06), ("footer", 0.06)):
            if r.random() < chance:
                self.clutter(kind)
        self.made += reversed(ends)

    def plain(self, between: str) -> str:
        """A page without blocks: its text is the article."""
        self.style = self.odd
        return self.MARK + between.join(self.sentence(2, 20) for _ in range(self.r.randint(1, 12)))

    def page(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.03:
            return self.plain(r.choice((" ", "\n", "<br>")))
        if kind < 0.08:
            self.made.append(r.choice(("", "<html><body>", "<body>")))
            self.article()
            return "".join(self.made)
        self.made.append(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>")
        wrapped = self.open(r.choice(("div", "div.container", "div.wrap", "div.page"))) if r.random() < 0.4 else ""
        for kind, chance in (("notice", 0.3), ("header", 0.55), ("nav", 0.75), ("ad", 0.5), ("form", 0.25), ("side", 0.25)):
            if r.random() < chance:
                self.clutter(kind)
        self.article()
        for kind, chance in (("side", 0.3), ("comments", 0.4), ("form", 0.2), ("ad", 0.25), ("nav", 0.2), ("footer", 0.85), ("notice", 0.1)):
            if r.random() < chance:
                self.clutter(kind)
        self.made.append(wrapped + ("</body></html>" if r.random() < 0.9 else ""))
        return "".join(self.made)


def training_page(seed: int) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made-up page and their labels."""
    made = blocks(_PageMaker(seed).page())
    mark = _PageMaker.MARK
    labels = np.array([mark in b.text for b in made], np.float64)
    return [Block(b.places, b.depth, b.text.replace(mark, "") or "x", b.link_chars) for b in made], labels


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Weights fitted by Adam on made-up pages; the same arguments give the same weights."""
    rng = np.random.default_rng(seed)
    data = [training_page(seed * 1_000_003 + i) for i in range(pages)]
    data = [(text_rows(b), [path_places(x.places) for x in b], y) for b, y in data if b]
    span = lambda n, *shape: rng.normal(0, 1 / math.sqrt(n), shape)
    par = {
        "path": span(12, PATH_DIMS, 8 * HIDDEN) * 0.5, "text": span(WORD_DIMS + MEASURES, WORD_DIMS + MEASURES, 8 * HIDDEN) * 0.5,
        "f": span(HIDDEN, HIDDEN, 4 * HIDDEN), "b": span(HIDDEN, HIDDEN, 4 * HIDDEN),
        "bias": np.zeros(8 * HIDDEN), "out": span(2 * HIDDEN, 2 * HIDDEN), "out_bias": np.zeros(1),
    }
    par = {k: v.astype(np.float32) for k, v in par.items()}
    for side in (0, 4):
        par["bias"][(side + 1) * HIDDEN : (side + 2) * HIDDEN] = 1.0
    mean = {k: np.zeros_like(v) for k, v in par.items()}
    power = {k: np.zeros_like(v) for k, v in par.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][2]) // 8)
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for g in rng.permutation(len(groups)):
            grad = _gradients(par, [data[i] for i in groups[g]], rng)
            step += 1
            rate = 0.012 * (1 - epoch / epochs) + 0.001
            for k, d in grad.items():
                mean[k] += 0.1 * (d - mean[k])
                power[k] += 0.01 * (d * d - power[k])
                par[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(power[k] / (1 - 0.99**step)) + 1e-8)
    f32 = lambda k: par[k].astype(np.float32)
    return Weights(f32("path"), f32("text"), (f32("f"), f32("b")), f32("bias"), f32("out"), float(par["out_bias"][0]))


def _gradients(par: dict, group: list, rng: np.random.Generator) -> dict:
    """Gradients of the mean loss over the blocks of some pages; now and then parts of paths are hidden."""
    lengths = np.array([len(y) for _, _, y in group])
    steps = lengths.max()
    paths = np.zeros((len(group), steps, PATH_DIMS), np.float32)
    texts = np.zeros((len(group), steps, WORD_DIMS + MEASURES), np.float32)
    y, mask = np.zeros((len(group), steps), np.float32), np.zeros((len(group), steps), np.float32)
    for r, (rows, places, labels) in enumerate(group):
        hidden = rng.random(PATH_DIMS) < rng.choice((0.0, 0.0, 0.15))
        for t, at in enumerate(places):
            paths[r, t, list(at)] = 1
        paths[r, :, hidden] = 0
        texts[r, : len(labels)] = rows
        texts[r, :, :WORD_DIMS] *= rng.random() < 0.7
        y[r, : len(labels)], mask[r, : len(labels)] = labels, 1
    z = paths @ par["path"] + texts @ par["text"] + par["bias"]
    kept_f, kept_b = [], []
    forward = _recur(z[:, :, : 4 * HIDDEN], par["f"], kept_f)
    backward = _turned(_recur(_turned(z[:, :, 4 * HIDDEN :], lengths), par["b"], kept_b), lengths)
    h = np.concatenate([forward, backward], axis=2)
    d = (_sigmoid(h @ par["out"] + par["out_bias"]) - y) * mask / mask.sum()
    dh = d[:, :, None] * par["out"]
    dz_f, df = _recur_back(dh[:, :, :HIDDEN], par["f"], kept_f)
    dz_b, db = _recur_back(_turned(dh[:, :, HIDDEN:], lengths), par["b"], kept_b)
    dz = np.concatenate([dz_f, _turned(dz_b, lengths)], axis=2)
    flat = dz.reshape(-1, 8 * HIDDEN)
    return {
        "path": paths.reshape(-1, PATH_DIMS).T @ flat, "text": texts.reshape(-1, WORD_DIMS + MEASURES).T @ flat, "f": df, "b": db,
        "bias": flat.sum(0), "out": np.tensordot(d, h, ((0, 1), (0, 1))), "out_bias": np.array([d.sum()]),
    }


def save(w: Weights, path: Path = WEIGHTS) -> None:
    """Weights in half precision, with what they were trained by."""
    half = {"path": w.path, "text": w.text, "f": w.back[0], "b": w.back[1], "bias": w.bias, "out": w.out, "out_bias": np.array([w.out_bias])}
    np.savez_compressed(path, trained_by=np.array([TRAIN_PAGES, EPOCHS, BATCH, SEED]), **{k: v.astype(np.float16) for k, v in half.items()})


@lru_cache(maxsize=1)
def trained() -> Weights:
    """The weights beside this module; ``python -m fernwalk.llm.block_labeller`` trains them anew."""
    with np.load(WEIGHTS) as held:
        f32 = {k: held[k].astype(np.float32) for k in held.files if k != "trained_by"}
    return Weights(f32["path"], f32["text"], (f32["f"], f32["b"]), f32["bias"], f32["out"], float(f32["out_bias"][0]))


if __name__ == "__main__":
    save(train())
