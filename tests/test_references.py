"""References and densest runs against Python's own decoder and all runs."""

from __future__ import annotations

import html
import random
from html.entities import html5

from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.functions import density, references
from fernwalk.functions import html as H

PIECES = st.one_of(
    st.sampled_from(["&", ";", "#", "x", "&amp;", "&lt", "&notit;", "&notin;", "&eacute;", "&mdash;", "&#8217;", "&#x41;", "&#X1F600;", "&#0;", "&#13;", "&#128;", "&#129;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#00065;", "&#11;", "&#xFFFF;", "&#xfdd0;", "&copycat", "&nosuchname;", "&CounterClockwiseContourIntegral;", "&fjlig;", "&NotEqualTilde;", " ", "a", "é", "&&gt;"]),
    st.sampled_from(sorted(html5)).map("&".__add__),
    st.integers(0, 0x120000).map("&#{};".format),
)


def both(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.p for r in df.select("i", references.unescape(df.t).alias("p")).orderBy("i").collect()]


def test_every_name_and_all_numbers_of_one_plane(spark):
    texts = [f"a&{n}b" for n in html5] + [f"&{n.rstrip(';')}" for n in html5] + [f"&#{n};&#x{n:x}" for n in [*range(0, 300), *range(0xD7F0, 0xE010), *range(0xFDC0, 0x10010), 0x10FFFE, 0x10FFFF, 0x110000, 1 << 40]]
    got = both(spark, texts)
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != html.unescape(t)] == []


def test_as_python_does(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=40, max_size=40))
    def run(texts):
        assert both(spark, texts) == [html.unescape(t) for t in texts]

    run()


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(references.unescape(df.t).alias("p")).first().p is None


def test_references_without_semicolon_stay_where_closed_ones_are_asked_for(spark):
    page = "<p>a&&&amp</p><p>&copy=1 &lt;b &notit; &#39 &#39;&#x41; &amp;lt;</p>"
    df = spark.createDataFrame([(page,)], "t string")
    row = df.select(references.unescape(df.t, closed=True).alias("p"), H.extract_article(df.t).alias("h"), density.extract_dense(df.t).alias("d")).first()
    assert row.p == "<p>a&&&amp</p><p>&copy=1 <b &notit; &#39 'A &lt;</p>"
    assert row.h.split() == ["a&&&amp", "&copy=1", "<b", "&notit;", "&#39", "'A", "&lt;"]
    # The run of the most words is the second paragraph.
    assert row.d.split() == row.h.split()[1:]


def test_densest_run_is_that_of_all_runs(spark):
    r = random.Random(4)
    rows = [[r.randint(-5, 5) for _ in range(r.randint(0, 12))] for _ in range(200)]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "i int, w array<int>")
    for row in got.select("i", "w", density.densest(got.w).alias("d")).collect():
        best = max([0, *(sum(row.w[a:b]) for a in range(len(row.w)) for b in range(a + 1, len(row.w) + 1))])
        assert row.d.best == best
        if best:
            assert sum(row.w[row.d.start - 1 : row.d.end]) == best


def test_articles_without_a_mark(spark):
    body = "".join(f"<p>{'word ' * 30}number {i}.</p>" for i in range(4))
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Item</a></li>" for i in range(12)) + "</ul>"
    pages = [(1, f"<body><nav>{menu}</nav><div><h1>Title here</h1>{body}</div><footer>{menu}</footer></body>"), (2, f"<article>{body}</article>{'loud ' * 900}"), (3, None), (4, ""), (5, "<p></p>"), (6, "plain < text")]
    df = spark.createDataFrame(pages, "i int, h string")
    got = {r.i: r.t for r in df.select("i", density.extract_dense(df.h).alias("t")).collect()}
    assert "number 0" in got[1] and "number 3" in got[1] and "Item" not in got[1]
    assert "loud" not in got[2] and "number 3" in got[2]
    assert got[3] is None and got[4] is None and got[5] is None and got[6] == "plain < text"
