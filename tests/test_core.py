"""Operators of the engine on rows that the tables lack, and the shape of their plans."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fernwalk import constants as C
from fernwalk.functions import html as H
from fernwalk.functions import text as T
from fernwalk.functions.urls import host, suffixes
from fernwalk.operators import compress, filters, merge, observe, rank, routing
from fernwalk.operators import sentences as S
from fernwalk.plans.gather import FALLBACKS, gather_all
from fernwalk.plans.search import query_terms, search
from fernwalk.sources import connectors, decoders, fetchers, pages
from fernwalk.sources.catalog import all_sources, resolve_sources
from fernwalk.sources.connectors import read_payloads, read_source


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_hosts_and_suffixes(spark):
    urls = ["https://User@WWW.Example.com:80/x", "bad url", None, "http://a.b.c"]
    assert one(spark, urls, host) == ["www.example.com", None, None, "a.b.c"]
    assert one(spark, ["a.b.c"], suffixes) == [["a.b.c", "b.c", "c"]]


def test_blocked_domains(spark):
    urls = [f"https://{p}{d}/x" for d in C.BLOCKED for p in ("", "www.", "a.b.")] + ["https://FORBES.com:443/"]
    fine = ["https://notforbes.com/", "https://acm.org/", "https://wiley.com/", "bad url", None]
    df = spark.createDataFrame([(u,) for u in urls + fine], "url string")
    assert len(C.BLOCKED) == 19
    kept = [r.url for r in filters.drop_blocked(df).collect()]
    assert kept == fine
    by_table = filters.drop_blocked_by_table(df, spark.createDataFrame([(d,) for d in C.BLOCKED], "domain string"))
    assert sorted(map(str, (r.url for r in by_table.collect()))) == sorted(map(str, fine))
    assert "NestedLoop" not in plan(filters.drop_blocked(df)) + plan(by_table)


def test_routes(spark):
    urls = ["https://x.com/a", "https://m.twitter.com/a", "https://en.wikipedia.org/wiki/A", "https://de.wikipedia.org/wiki/A", "https://www.github.com/a", "https://gist.github.com/a", "https://notx.com/", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.method for r in routing.route(df).collect()] == ["fxtwitter", "fxtwitter", "mediawiki", "http", "github", "http", "http", "http"]
    assert routing.routes(spark).count() == 8


def test_flags(spark):
    sets = {"none": [], "sci": ["sci"], "both": ["sci", "med"], "all": ["sci", "med", "tech"]}
    got = resolve_sources(spark.createDataFrame(list(sets.items()), "query_id string, flags array<string>")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.source)
    assert sorted(by["both"]) == ["arxiv", "europepmc", "openalex", "pubmed"]
    assert len(by["all"]) == 8
    assert "none" not in by
    base = resolve_sources(spark.createDataFrame([("q", [])], "query_id string, flags array<string>"), base=C.BASE_SOURCES)
    assert base.count() == 3
    assert len(all_sources()) == 11


def test_languages_and_regions(spark):
    cases = {"葛飾北斎の絵": "ja", "北京": "zh", "한국": "ko", "погода": "ru", "طقس": "ar", "อากาศ": "th", "plain": "other", "": "other", None: None}
    assert one(spark, list(cases), T.detect_language) == list(cases.values())
    assert one(spark, ["ja", "other", None], T.region) == ["jp-jp", "wt-wt", "wt-wt"]


def test_text_clean_up(spark):
    assert one(spark, ["a &amp;lt; b &lt;", None], T.decode_entities) == ["a &lt; b <", None]
    assert one(spark, ["x[1] y[note]"], T.strip_citations) == ["x y[note]"]
    assert one(spark, ["# T\n\n- *a* **b** [l](u) ![i](j)\n```py\nx\n```"], T.strip_markdown) == ["T\n\n*a* b l \n\nx\n"]
    assert one(spark, ["東京 ab あ"], T.cjk_words) == [["東京", "ab", "あ"]]
    assert one(spark, ["東京都"], T.cjk_words) == [["東京", "京都"]]
    assert one(spark, ["12345", ""], T.token_estimate) == [2, 0]


def test_html(spark):
    page = '<body><nav>x</nav><article><script>var a="</p>";</script><h1>A</h1><p>b <b>c<p>d &amp;lt; e</article><footer>f</footer>'
    assert one(spark, [page], H.extract_article)[0].strip().split("\n") == ["A", "", "b c", "d &lt; e"]
    assert [x and x.strip() for x in one(spark, ["<p>no article</p>", None], H.extract_article)] == ["no article", None]
    assert one(spark, ["<p>x</p>"], H.article_html) == [None]


SENT = [(1, 0, "the same here"), (1, 1, "The Same here "), (2, 0, "the same here"), (2, 1, "123"), (3, 0, "other words the"), (3, 1, "x" * 50)]


@pytest.fixture
def sent(spark):
    return spark.createDataFrame(SENT, "doc_id long, pos int, s string")


def test_dedup_keeps_the_first(sent, spark):
    once = S.dedup_across_pages(sent, ["doc_id", "pos"])
    got = sorted((r.doc_id, r.pos) for r in once.collect())
    assert got == [(1, 0), (2, 1), (3, 0), (3, 1)]
    assert sorted((r.doc_id, r.pos) for r in S.dedup_across_pages(once, ["doc_id", "pos"]).collect()) == got
    more = sent.union(spark.createDataFrame([(9, 0, "other words the"), (9, 1, "new")], sent.schema))
    assert {(r.doc_id, r.pos) for r in S.dedup_across_pages(more, ["doc_id", "pos"]).collect()} == {*got, (9, 1)}
    assert "WindowGroupLimit" in plan(S.dedup_across_pages(sent, ["doc_id", "pos"]))


def test_scores(sent):
    b = rank.bm25(sent, ["the", "words", "missing"], ["doc_id", "pos"])
    scores = {(r.doc_id, r.pos): r.bm25 for r in b.collect()}
    assert set(scores) == {(1, 0), (1, 1), (2, 0), (3, 0)}
    assert scores[3, 0] > scores[1, 0] > 0
    assert "Exchange hashpartitioning" not in plan(b)
    assert rank.bm25(sent, [], ["doc_id", "pos"]).collect() == []
    c = {(r.doc_id, r.pos): r.centrality for r in rank.centrality(sent).collect()}
    assert c[1, 0] == 1.0
    assert (2, 1) not in c
    assert plan(rank.centrality(sent)).count("Exchange hashpartitioning") <= 2
    total = {(r.doc_id, r.pos): r.score for r in rank.combine(sent, b, rank.centrality(sent), 0.5).collect()}
    assert total[2, 1] == 0.0
    assert total[1, 0] == pytest.approx(scores[1, 0] + 0.5, abs=1e-6)
    with pytest.raises(ValueError, match="method"):
        rank.centrality(sent, "pairs")


def test_budgets(spark):
    rows = [(1, i, "x" * n, s) for i, (n, s) in enumerate([(30, 5.0), (80, 4.0), (20, 3.0), (20, 3.0), (200, 9.0)])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, s string, score double")
    assert [r.pos for r in compress.select_within_budget(df, 100).collect()] == []
    assert sorted(r.pos for r in compress.select_within_budget(df, 100, "skip").collect()) == [0, 2, 3]
    assert sorted(r.pos for r in compress.select_within_budget(df.where("pos < 4"), 115).collect()) == [0, 1]
    assert sorted(r.pos for r in compress.select_within_budget(df, 20, "skip", T.token_estimate(F.col("s"))).collect()) == [0, 2, 3]
    with pytest.raises(ValueError, match="strategy"):
        compress.select_within_budget(df, 1, "best")


def test_caps_merges_and_fallbacks(spark):
    df = spark.createDataFrame([("q", s, i, f"u{i}") for s in ("a", "b") for i in range(8)], "query_id string, source string, rank int, url string")
    capped = merge.top_per_source(df, F.lit(1), F.col("rank"))
    assert capped.count() == 10
    assert "WindowGroupLimit" in plan(capped)
    top = merge.top_results(df, F.col("rank"), F.col("source"), 3)
    assert [(r.source, r.rank) for r in top.collect()] == [("a", 0), ("b", 0), ("a", 1)]
    assert "TakeOrderedAndProject" in plan(top)
    assert merge.merge_sources(df, df.drop("url")).where("url IS NULL").count() == 16
    other = spark.createDataFrame([("q", "c", 0, "x"), ("r", "c", 0, "y")], df.schema)
    assert [r.url for r in merge.with_fallback(df, other).where("source = 'c'").collect()] == ["y"]
    assert merge.with_fallback(df.limit(0), other, None).count() == 2
    assert merge.with_fallback(df, other, None).count() == 16
    r = merge.rank_fusion(spark.createDataFrame([("a", 1), ("b", 2)], "i string, rk int"), spark.createDataFrame([("b", 1)], "i string, rk int"), item="i")
    assert r.orderBy(F.desc("score")).first().i == "b"


def test_observations(spark):
    df = spark.createDataFrame([("u1", "fetch", True, None, 10), ("u2", "fetch", False, "timeout", 90), ("u3", "fetch", False, None, 50)], "url string, phase string, ok boolean, error_class string, elapsed_ms int")
    assert {(r.error_class, r.n) for r in observe.failure_breakdown(df).collect()} == {("timeout", 1), ("unknown", 1)}
    assert [r.url for r in observe.slow_urls(df, 2).collect()] == ["u2", "u3"]
    assert observe.phase_timing(df).first().p95_ms == 86.0
    assert filters.ok_only(df).count() == 1


PAYLOADS = {
    "hackernews": {"hits": [{"objectID": "7", "title": "T", "url": None, "points": 3, "num_comments": 1}]},
    "stackoverflow": {"items": [{"link": "l", "title": "T", "body": "B", "score": 2}]},
    "devto": [{"url": "u", "title": "T", "description": "D", "positive_reactions_count": 4}],
    "github": {"items": [{"html_url": "h", "full_name": "a/b", "description": "D", "stargazers_count": 9}]},
    "openalex": {"results": [{"id": "i", "display_name": "N", "cited_by_count": 5, "open_access": {"is_oa": True, "oa_url": "o"}}]},
    "semanticscholar": {"data": [{"url": "u", "title": "T", "abstract": "A", "citationCount": 1, "openAccessPdf": {"url": "p"}}]},
    "pubmed": {"esearchresult": {"idlist": ["12", "34"]}},
    "europepmc": {"resultList": {"result": [{"id": "1", "source": "MED", "title": "T", "abstractText": "A", "citedByCount": 8, "fullTextUrlList": {"fullTextUrl": [{"url": "f"}]}}]}},
    "web": {"results": [{"url": "u", "title": "T", "snippet": "S"}]},
}
ATOM = '<feed><entry><id>http://arxiv.org/abs/1</id><title>A\n  B</title><summary>S &amp;amp; T</summary></entry></feed>'


def canned(source, query, n):
    """What the connector fetches in these tests."""
    if query == "down":
        raise OSError("no network")
    return ATOM if source == "arxiv" else json.dumps(PAYLOADS[source])


def test_every_source_is_decoded(spark):
    for source in [*PAYLOADS, "arxiv"]:
        got = read_source(spark, source, [("q1", "x")], fetch="tests.test_core:canned").collect()
        assert got, source
        assert {(r.query_id, r.source) for r in got} == {("q1", source)}
        assert got[0].url
    assert read_source(spark, "github", [("q", "x")], fetch="tests.test_core:canned").first().metrics == {"stars": 9.0}
    assert read_source(spark, "arxiv", [("q", "x")], fetch="tests.test_core:canned").first().snippet == "S &amp; T"
    assert set(decoders.SHAPES) | {"arxiv"} >= set(all_sources())


def test_failed_attempts_are_told(spark):
    got = read_payloads(spark, [("a", "x"), ("b", "down")], ["web", "github"], fetch="tests.test_core:canned").collect()
    assert len(got) == 4
    assert {r.error_class for r in got if r.query_id == "b"} == {"OSError"}


def test_unreadable_payloads_have_no_results(spark):
    df = spark.createDataFrame([("q", "not json"), ("q", None), ("q", "{}")], "query_id string, payload string")
    for source in [*decoders.SHAPES, "arxiv"]:
        assert decoders.decode_results(df, source).collect() == []


def test_fetch_routes_decodes_and_falls_back(spark):
    results = spark.createDataFrame([("https://x.com/a/1", None), ("https://reddit.com/r/x", "snip"), ("https://e.example/1", None), ("https://e.example/2", None), ("https://e.example/3", None)], "url string, snippet string")
    raw = spark.createDataFrame(
        [("https://x.com/a/1", json.dumps({"tweet": {"text": "hi", "likes": 3, "retweets": 1, "author": {"name": "A"}}}), None, 5), ("https://e.example/1", "<article><p>x</p></article>", None, 7), ("https://e.example/2", None, "timeout", 9)],
        "url string, raw string, error_class string, elapsed_ms int",
    )
    archive = spark.createDataFrame([("https://e.example/2", "<article>old</article>")], "url string, raw string")
    got = {r.url: r for r in fetchers.fetch(results, raw, archive).collect()}
    assert got["https://x.com/a/1"].body == "A\nhi"
    assert got["https://x.com/a/1"].metrics == {"likes": 3.0, "retweets": 1.0}
    assert got["https://reddit.com/r/x"].body == "snip"
    assert got["https://e.example/1"].body.strip() == "x"
    assert got["https://e.example/2"].body == "old"
    assert (got["https://e.example/3"].ok, got["https://e.example/3"].error_class) == (False, "empty")
    assert {r.url: r.error_class for r in fetchers.fetch(results, raw).collect()}["https://e.example/2"] == "timeout"


def fetched(address):
    """What the page fetcher gets in these tests."""
    if "down" in address and "web.archive.org" not in address:
        raise TimeoutError
    return f"<article><p>{address}</p></article>"


def test_pages_are_fetched_by_route_and_from_the_archive(spark):
    urls = ["https://a.example/1", "https://a.example/1", "https://a.example/down", "https://github.com/a/b", "https://reddit.com/r/x", None]
    results = spark.createDataFrame([(u, "snip") for u in urls], "url string, snippet string")
    for lanes in (1, 3):
        raw = pages.fetch_raw(results, "tests.test_core:fetched", threads=2, lanes=lanes)
        got = {r.url: r for r in raw.collect()}
        assert sorted(got) == ["https://a.example/1", "https://a.example/down", "https://github.com/a/b"]
        assert got["https://a.example/down"].error_class == "TimeoutError"
        assert got["https://a.example/down"].raw is None
        assert got["https://github.com/a/b"].raw == "<article><p>https://api.github.com/repos/a/b/readme</p></article>"
    archive = pages.fetch_archive(raw, "tests.test_core:fetched")
    bodies = {r.url: r.body.strip() for r in fetchers.fetch(results, raw, archive).where("ok").collect()}
    assert bodies["https://a.example/1"] == "https://a.example/1"
    assert bodies["https://a.example/down"] == "https://web.archive.org/web/2id_/https://a.example/down"
    assert bodies["https://reddit.com/r/x"] == "snip"
    assert pages.fetch_raw(results.limit(0), "tests.test_core:fetched").collect() == []
    none = spark.createDataFrame([("u", None)], "url string, address string")
    assert [r.error_class for r in pages.fetch_addresses(none, "tests.test_core:fetched").collect()] == ["no_address"]


def test_addresses_of_searches():
    assert connectors.address("devto", "a b&c", 5) == "https://dev.to/search/feed_content?class_name=Article&per_page=5&search_fields=a%20b%26c"
    assert set(connectors.ENDPOINTS) == {*all_sources(), *FALLBACKS.values()}  # every source has an address
    assert connectors.address("web", "a b&c", 5).endswith("?q=a%20b%26c")


def test_pubmed_records_follow_the_ids(monkeypatch):
    asked = []

    def get(url):
        asked.append(url)
        return "<records>" if "efetch" in url else json.dumps({"esearchresult": {"idlist": ["1", "2"] if "fox" in url else []}})

    monkeypatch.setattr(connectors, "_get", get)
    assert connectors.http_fetch("pubmed", "fox", 5) == "<records>"
    assert asked[1].endswith("id=1,2")
    assert json.loads(connectors.http_fetch("pubmed", "none", 5)) == {"esearchresult": {"idlist": []}}
    assert len(asked) == 3


def test_sources_that_fail_are_told(spark):
    got = gather_all(spark, [("q1", "down", ["tech"])], fetch="tests.test_core:canned")
    assert got.results.isEmpty()
    assert {r.source for r in got.failures.collect()} == {"web", "web_fallback", "news", "discussions", "hackernews", "stackoverflow", "devto", "github"}
    assert {r.error_class for r in got.failures.collect()} == {"OSError"}
    assert gather_all(spark, [("q1", "fox", [])], fetch="tests.test_core:gathered").failures.isEmpty()


def test_records_name_their_open_full_texts(spark):
    record = {"resultList": {"result": [{"title": "T", "fullTextUrlList": {"fullTextUrl": [{"availabilityCode": "OA", "url": "o"}, {"availabilityCode": "S", "url": "s"}]}}]}}
    results = spark.createDataFrame([("https://europepmc.org/article/MED/1", None), ("https://e.example/", None)], "url string, snippet string")
    raw = spark.createDataFrame([("https://europepmc.org/article/MED/1", json.dumps(record), None, 1), ("https://e.example/", "x", None, 1)], "url string, raw string, error_class string, elapsed_ms int")
    assert {r.url: r.links for r in fetchers.fetch(results, raw).collect()} == {"https://europepmc.org/article/MED/1": ["o"], "https://e.example/": None}


def test_one_budget_for_the_whole_answer(spark):
    pages = spark.createDataFrame([(i, f"https://h{i}.example/", f"<p>The fox number {'abcdefghij'[i]} runs. A dog sleeps {i}.</p>") for i in range(10)], "page_id long, url string, html string")
    got = search(pages, "fox", 60, strategy="total").collect()
    assert 0 < sum(len(r.s) for r in got) <= 60 and all("fox" in r.s for r in got)
    assert len(search(pages, "fox", 60).collect()) == 20


def test_open_access_is_preferred_for_works_only(spark):
    from fernwalk.plans.gather import gather

    got = gather(spark, [("q2", "rare", ["sci"])], fetch="tests.test_core:gathered").collect()
    assert [r.url for r in got if r.source == "openalex"] == ["o"]
    assert [(r.url, r.oa_url) for r in got if r.source == "semanticscholar"] == [("u", "p")]


def test_article_marks_and_breaks(spark):
    page = '<ARTICLE class="a"><P>x</P><SCRIPT>no</SCRIPT><link rel="x"><pre>code</pre><p class="b">y</article>'
    assert one(spark, [page], H.extract_article)[0].strip().split("\n") == ["x", " code", "y"]


def gathered(source, query, n):
    if source == "arxiv" or source == "web" and query == "rare":
        return "<feed></feed>" if source == "arxiv" else json.dumps({"results": []})
    if source == "github":
        return json.dumps({"items": [{"html_url": f"https://github.com/a/{i}", "full_name": f"a/{i}", "description": "fox tools", "stargazers_count": i} for i in range(9)]})
    if source in ("web", "web_fallback", "news", "discussions"):
        host = "www.forbes.com" if source == "news" else f"{source.replace('_', '-')}.example"
        return json.dumps({"results": [{"url": f"https://{host}/{i}", "title": "t", "snippet": "A fox snippet."} for i in range(8)]})
    return json.dumps(PAYLOADS[source])


def test_gathering_and_answering(spark):
    from fernwalk.plans.gather import answer, gather, sources_of, with_regions

    got = gather(spark, [("q1", "fox", ["tech"]), ("q2", "rare", ["sci"])], fetch="tests.test_core:gathered")
    counts = {(r.query_id, r.source): r["count"] for r in got.groupBy("query_id", "source").count().collect()}
    assert counts == {
        ("q1", "web"): 8, ("q1", "discussions"): 5, ("q1", "hackernews"): 1, ("q1", "stackoverflow"): 1, ("q1", "devto"): 1, ("q1", "github"): 5,
        ("q2", "web_fallback"): 8, ("q2", "discussions"): 5, ("q2", "openalex"): 1, ("q2", "semanticscholar"): 1,
    }
    assert [r.url[-1] for r in got.where("source = 'github'").orderBy("rk").collect()] == list("87654")
    assert [r.url for r in got.where("source = 'openalex'").collect()] == ["o"]
    assert sources_of(["sci", "med"]).count("openalex") == 1
    raw = spark.createDataFrame([("https://web.example/0", "<article><p>The fox runs. It rains.</p></article>", None, 1), ("https://web.example/1", "<article><p>The fox runs. More foxes.</p></article>", None, 1)], "url string, raw string, error_class string, elapsed_ms int")
    said = {(r.url, r.s) for r in answer(got.where("query_id = 'q1'"), raw, "fox").collect()}
    assert ("https://web.example/0", "The fox runs") in said
    assert ("https://web.example/1", "The fox runs") not in said
    asked = with_regions(spark.createDataFrame([("q", "日本の絵")], "query_id string, text string")).first()
    assert (asked.lang, asked.region) == ("ja", "jp-jp")


def test_observed_counts_come_with_the_run(spark):
    df = spark.createDataFrame([(True, 1), (False, 9)], "ok boolean, elapsed_ms int")
    same, seen = observe.observed(df, "attempts_seen")
    assert same.count() == 2
    assert seen.get == {"attempts": 2, "failures": 1, "slowest_ms": 9}


def test_pdfs_are_skipped_without_an_extractor(spark):
    df = spark.createDataFrame([("u", "application/pdf", bytearray(b"%PDF")), ("v", "text/html", bytearray(b"")), ("w", None, None)], "url string, content_type string, content binary")
    assert [r.url for r in filters.skip_pdf(df, False).collect()] == ["v", "w"]
    assert filters.skip_pdf(df, True).count() == 3
    assert fetchers.pdf_text(df, False).collect() == []
    assert {r.body for r in fetchers.pdf_text(df, True).collect()} <= {None, ""}


def test_search(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.example/", "<article><p>The fox runs. A dog sleeps.</p></article>"), (2, "https://b.example/", "<article><p>The fox runs. Foxes eat berries.</p></article>"), (3, "https://www.forbes.com/", "<article>The fox is rich.</article>")],
        "page_id long, url string, html string",
    )
    got = [(r.doc_id, r.s) for r in search(pages, "the fox", 400).collect()]
    assert (1, "The fox runs") in got
    assert (2, "The fox runs") not in got
    assert all(d != 3 for d, _ in got)
    assert query_terms("The fox, the 2 dogs") == ["the", "fox", "dogs"]
    assert search(pages.limit(0), "fox").collect() == []


def test_streams(spark, tmp_path):
    from fernwalk.streaming.streams import dedup_stream, timing_stream

    spark.createDataFrame([(1, "a b. c d."), (2, "A b.\nnew")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/docs")
    q = dedup_stream(stream).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert {r.s.lower().rstrip(".") for r in spark.table("seen").collect()} == {"a b", "c d", "new"}
    ev = "ts timestamp, event_type string, value double"
    days = "timestamp'2024-01-01 01:00:00' + make_dt_interval(CAST(i AS INT))"
    spark.sql(f"SELECT {days} AS ts, 'x' AS event_type, CAST(i AS DOUBLE) AS value FROM range(4) AS t(i)").coalesce(1).write.parquet(f"{tmp_path}/events")
    q = timing_stream(spark.readStream.schema(ev).parquet(f"{tmp_path}/events")).writeStream.format("memory").queryName("timed").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("timed").orderBy("start").collect()] == [1, 1, 1]
