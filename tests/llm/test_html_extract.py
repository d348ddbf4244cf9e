from __future__ import annotations

import re
import time
import tracemalloc
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from fernwalk.llm import block_labeller as L
from fernwalk.llm.html_blocks import blocks, name_places, near_places
from fernwalk.llm.html_extract import extract_text
from tests.llm.conftest import clash, rows
from tests.parity import SF, needs_data

PAGES = "page_id long, url string, html string"


def path(*names):
    """The places of a path, by all its names and the tags of the last three."""
    out = near_places(*(n.split(".")[0] for n in names[:-4:-1]))
    for n in names:
        out |= name_places(n)
    return out


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var t="</p>";</script>
    <!-- <p>no</p> --><div class="ad x">Ad &amp;lt;</div><p>One <b>bold
    <i>two</i><br>three<p>Four<ul><li>a<li>b <a href='q>r'>link</a></ul>tail &copy; &nbsp; end<textarea><p>x</p></textarea><svg><text>y</text></svg></body>"""
    assert texts(page) == ["Ad &lt;", "One bold two three", "Four", "a", "b link", "tail © end"]
    b = blocks(page)
    assert [x.depth for x in b] == [3, 3, 3, 4, 4, 2]
    assert b[0].places == path("html", "body", "div.ad.x")
    assert b[1].places == b[2].places == path("html", "body", "p")
    assert b[4].places == path("html", "body", "ul", "li")
    assert b[4].link_chars == 4


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "</p></div>", "<p>" * 3000, "a<b", "<div class=>", "<a =\"", "<a ='>'", "</", "</p", "<!", "<?", "<>", "a < b", "<svg><svg></svg>", "<template>x", "<button>", "&#0;&#xD800;&bogus;", "<a", "<title>x", "\x00"])
def test_broken_pages_dont_crash(page):
    for b in blocks(page):
        assert b.text
        assert "\n" not in b.text


def test_cut_off_pages_keep_their_text():
    assert texts("<body><article><h1>A</h1><p>B <b>c") == ["A", "B c"]


def test_what_isnt_closed_ends_in_the_right_place():
    assert texts("<button>OK<p>Text</p><p>More") == ["Text", "More"]
    assert texts("<div><select><option>a<option>b</div><p>Text</p>") == ["Text"]
    assert texts("<p>Press <button>OK</button> to go on</p>") == ["Press to go on"]
    assert texts("<svg><svg><text>x</text></svg><text>y</text></svg><p>Text") == ["Text"]
    assert texts("<svg><text>x<p>Text") == ["Text"]
    assert texts("<title>T<p>Text") == ["T", "Text"]
    assert texts("<iframe src=x><p>Text") == ["Text"]
    assert texts("<template><p>no</p></template><template><p>Text") == ["Text"]
    assert texts("<!-- x ><p>Text") == ["Text"]
    assert texts("<p>a<script>var x = '<p>no'") == ["a"]
    assert texts("<SCRIPT>no</ScRiPt ><p>Text") == ["Text"]
    assert texts("<p title='a>b' class=\"c>d\">Text <a href='x>no end") == ["Text no end"]


def test_content_that_may_be_text_is_kept():
    assert texts("<p>Let <math><mi>p</mi></math> be prime.") == ["Let p be prime."]
    assert texts("<noscript><p>Text</p></noscript><object><p>More</p></object>") == ["Text", "More"]


MB = 1_000_000


@pytest.mark.parametrize(
    "page",
    [
        "<a " * (MB // 3), "<!" * (MB // 2), "<!--" * (MB // 4), "<a ='" * (MB // 5), "<a =\"x' >" * (MB // 9), "<div>a" * 200_000, "<div>" * 100_000 + "</x>" * 100_000,
        "<p><div>" + "<x>" * 50_000 + "<p></p>" * 50_000, "<script>" * (MB // 8), "<textarea>" * (MB // 10), "</script" * (MB // 8) + "<script>", "<svg>" * (MB // 5), "<" * MB,
        "<button>" * (MB // 8), "class=\"" * (MB // 7), "<a class" + " " * MB + ">x", "<a " + "class=' " * (MB // 8) + ">x", "x &amp" * (MB // 6), "<p>word " * 100_000, "<a =" + " " * MB,
    ],
)
def test_broken_pages_cost_no_more_than_others(page):
    begun = time.process_time()
    made = blocks(page)
    assert time.process_time() - begun < 6
    assert all(b.text for b in made)


def test_deep_pages_take_little_memory():
    page = "<div>a" * 50_000
    tracemalloc.start()
    blocks(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1000 * 50_000


def test_gradients_are_right():
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    group = [(L.text_rows(b), [L.path_places(x.places) for x in b], y) for b, y in (L.training_page(i) for i in (1, 2, 3)) if b]
    d = L.HIDDEN
    par = {
        "path": rng.normal(0, 0.1, (L.PATH_DIMS, 8 * d)), "text": rng.normal(0, 0.1, (L.WORD_DIMS + L.MEASURES, 8 * d)), "f": rng.normal(0, 0.2, (d, 4 * d)),
        "b": rng.normal(0, 0.2, (d, 4 * d)), "bias": rng.normal(0, 0.1, 8 * d), "out": rng.normal(0, 0.3, 2 * d), "out_bias": np.zeros(1),
    }

    class Still:
        random = staticmethod(lambda n=None: np.ones(n) if n else 0.0)
        choice = staticmethod(lambda x: 0.0)

    grad = L._gradients(par, group, Still)

    def loss(p):
        w = L.Weights(p["path"], p["text"], (p["f"], p["b"]), p["bias"], p["out"], float(p["out_bias"][0]))
        z = 0.0
        pages = [L.training_page(i) for i in (1, 2, 3)]
        pages = [x for x in pages if x[0]]
        got = L.label_pages([b for b, _ in pages], w, {})
        for q, (_, y) in zip(got, pages, strict=True):
            q = np.clip(q.astype(np.float64), 1e-12, 1 - 1e-12)
            z -= (y * np.log(q) + (1 - y) * np.log(1 - q)).sum()
        return z / sum(len(y) for _, y in pages)

    for k, at in (("out", (3,)), ("out_bias", (0,)), ("f", (2, 5)), ("b", (1, 40)), ("text", (L.WORD_DIMS, 9)), ("bias", (70,))):
        e = 1e-2
        up, down = ({n: v.copy() for n, v in par.items()} for _ in range(2))
        up[k][at] += e
        down[k][at] -= e
        assert grad[k][at] == pytest.approx((loss(up) - loss(down)) / (2 * e), abs=3e-4), k


def test_batches_dont_change_labels(monkeypatch):
    w = L.trained()
    pages = [L.training_page(i)[0] for i in range(50, 80)] + [[]]
    whole = L.label_pages(pages, w, {})
    monkeypatch.setattr(L, "STEP_BLOCKS", 1)
    for a, b in zip(whole, L.label_pages(pages, w, {}), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-4)


def test_training_gives_the_weights():
    """The file holds what training gives, up to what half precision and another machine's sums change."""
    with np.load(L.WEIGHTS) as held:
        assert held["trained_by"].tolist() == [L.TRAIN_PAGES, L.EPOCHS, L.BATCH, L.SEED]
    w, again = L.trained(), L.train()
    same = total = 0
    for i in range(6_000_000, 6_000_200):
        b, _ = L.training_page(i)
        if b:
            same += int(((L.label_pages([b], w, {})[0] >= 0.5) == (L.label_pages([b], again, {})[0] >= 0.5)).sum())
            total += len(b)
    assert same / total >= 0.985


def test_held_out_accuracy():
    w = L.trained()
    right = total = 0
    for i in range(5_000_000, 5_000_300):
        b, y = L.training_page(i)
        if b:
            right += int(((L.label_pages([b], w, {})[0] >= 0.5) == (y > 0)).sum())
            total += len(y)
    assert right / total >= 0.985


PAGE = """<html><body><div class="cookie-notice">We use cookies. <button>OK</button></div><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>First   paragraph of the story, with enough words to be one.</p><div class="ad">Buy now!</div>
<p>Second<br>paragraph of it, and it has some more words than the first one.</p></article>
<aside class="sidebar"><h3>Popular</h3><a href="/x">Other story</a></aside>
<section class="comments"><div class="comment"><p>I disagree with all of this.</p></div></section><footer>&copy; 2020 Site</footer></body></html>"""


def test_a_page_with_everything(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<script>x</script>")], PAGES)
    got = rows(extract_text(df))
    want = "A & B\nFirst paragraph of the story, with enough words to be one.\nSecond paragraph of it, and it has some more words than the first one."
    assert got == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (2, None, "", 0), (3, "u", "", 0), (None, "u", "", 0)], key=repr)
    assert extract_text(df.limit(0)).collect() == []


class Marked(HTMLParser):
    """The words of a page's article element, without those of parts in it that are marked as something else."""

    def __init__(self, page):
        super().__init__()
        self.open, self.words = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "aside", "nav", "form", "section", "header", "footer") or tag == "div" or tag in ("script", "style"):
            self.open.append((tag, tag != "article" and not (tag == "div" and not attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        at = [t for t, _ in self.open]
        if "article" in at and not any(out for _, out in self.open[at.index("article") :]):
            self.words += data.split()


@needs_data
def test_marked_articles_of_the_tables():
    """Pages that the network wasn't trained on, whose articles an element marks."""
    w = L.trained()
    for (page,) in duckdb.execute(f"SELECT html FROM read_parquet('{SF}/pages.parquet')").fetchall():
        found = blocks(page)
        likely = L.label_pages([found], w, {})[0]
        assert " ".join(b.text for b, p in zip(found, likely, strict=True) if p >= 0.5).split() == Marked(page).words


def extracted(page):
    found = blocks(page)
    return "\n".join(b.text for b, p in zip(found, L.label_pages([found], L.trained(), {})[0], strict=True) if p >= 0.5)


PARAGRAPHS = ["The river had risen in the night.", "By morning the lower fields were under water, and the road to the mill could not be seen.", "No one had gone to bed."]


@pytest.mark.parametrize("page", ["<p>{}</p><p>{}</p><p>{}</p>", "<body><h1>{}</h1><p>{}</p><p>{}</p></body>", "<noscript><article><p>{}</p><p>{}</p><p>{}</p></article></noscript>", "<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><p>{}<p>{}<p>{}<footer>&copy; 2020 Site</footer>"])
def test_pages_without_an_article_element(page):
    assert extracted(page.format(*PARAGRAPHS)) == "\n".join(PARAGRAPHS)


def test_a_page_without_tags():
    text = " ".join(PARAGRAPHS)
    assert extracted(text) == text
    assert extracted("<article><p>Let <math><mi>p</mi></math> be prime.</p><p>Then it has no other divisors than one and itself.</p></article>").startswith("Let p be prime.")


def test_long_pages_and_clashing_columns(spark):
    body = "".join(f"<p>Paragraph {i} of a long story, with words enough to be one.</p>" for i in range(5000))
    long = f"<html><body><nav><a href=/>Home</a></nav><article>{body}</article><footer>&copy; 2020</footer></body></html>"
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", long)], PAGES)
    got = rows(extract_text(clash(df)))
    assert got == rows(extract_text(df))
    assert got[1][2] == re.sub(r"</?p>", "", body.replace("</p><p>", "\n"))
