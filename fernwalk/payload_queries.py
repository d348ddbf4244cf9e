"""Queries that decode what services and page interfaces answer.

The tables hold no such answers, so Spark makes one of each document: a template of the
service's answer, chosen by the document's id, filled with its id, title, text and length.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwalk.operators import filters, routing
from fernwalk.session import table
from fernwalk.sources import decoders, pages

Query = Callable[[SparkSession, str], DataFrame]

#: What the templates' marks stand for: ``@id``, ``@n`` characters, ``@title`` and ``@text`` without what JSON and XML would escape.
UNSAFE, TITLE = r"[^\p{L}\p{M}\p{N} .,;:!?]", r"^[^.!?]*"
#: Payloads without hits; every source is given them too.
NO_HITS = ("not json", "", "{}", "<html></html>", None)
RESULT_PAGE = """<div class="result"><a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&amp;rut=9">The <b>fox</b> &amp; @title</a>
<a class="result__snippet" href="//duckduckgo.com/l/?uddg=z">A <b>fox</b>
 @text</a></div><div class="result result--ad"><a class="result__a" href="https://duckduckgo.com/y.js?ad_domain=b.example">Buy</a></div>
<div class="result"><a class="result__a" href="https://c.example/@id">Plain</a></div>"""
FEED = """<rss><channel><title>Not an item</title><item><title>A &amp;lt;fox&amp;gt; @title</title><link>https://a.example/?i=@id&amp;amp;x=1</link><description><![CDATA[<b>@text</b>]]></description></item>
<item><title><![CDATA[Bare]]></title><link>https://b.example/</link></item></channel></rss>"""
_WEB = ({"results": [{"url": "https://a.example/@id", "title": "@title", "snippet": "@text"}, {"url": "https://b.example/", "title": None}]}, RESULT_PAGE, FEED)
SEARCHES = {
    "web": _WEB,
    "web_fallback": _WEB,
    "news": _WEB,
    "discussions": _WEB,
    "hackernews": (
        {"hits": [{"objectID": "@id", "title": "@title", "url": None, "points": "@n", "num_comments": 1}, {"objectID": "8", "title": "Ü", "url": "https://a.example/@id", "story_text": "@text"}]},
        {"hits": []},
    ),
    "stackoverflow": ({"items": [{"link": "l/@id", "title": "@title", "body": "<code>@text</code>", "score": -2, "answer_count": "@n"}, {"link": "m", "title": "U"}]},),
    "devto": ([{"url": "u/@id", "title": "@title", "description": "@text", "positive_reactions_count": "@n"}, {"url": "v", "title": "W"}], [], {"result": [{"path": "/a/@id", "title": "@title", "public_reactions_count": "@n", "highlight": {"body_text": ["@text", "more"]}}, {"path": "/b", "title": "W"}]}),
    "github": ({"items": [{"html_url": "h/@id", "full_name": "a/@id", "description": "@text", "stargazers_count": "@n"}, {"html_url": "i", "full_name": "c/d", "stargazers_count": 0}]},),
    "openalex": ({"results": [{"id": "i/@id", "display_name": "@title", "cited_by_count": "@n", "open_access": {"is_oa": True, "oa_url": "o/@id"}}, {"id": "j", "display_name": "M", "open_access": None}]},),
    "semanticscholar": ({"data": [{"url": "u/@id", "title": "@title", "abstract": "@text", "citationCount": "@n", "openAccessPdf": {"url": "p"}}, {"url": "v", "title": "W", "openAccessPdf": None}]},),
    "pubmed": (
        {"esearchresult": {"idlist": ["@id", "34"]}},
        '<PubmedArticleSet><PubmedArticle><PMID Version="1">@id</PMID><ArticleTitle>On <i>foxes</i> &amp; @title</ArticleTitle><AbstractText Label="A">@text</AbstractText>\n'
        '<AbstractText>Two\n lines.</AbstractText></PubmedArticle><PubmedArticle><PMID>6</PMID><ArticleTitle>Bare</ArticleTitle></PubmedArticle></PubmedArticleSet>',
    ),
    "europepmc": (
        {"resultList": {"result": [{"id": "@id", "source": "MED", "title": "@title", "abstractText": "@text", "citedByCount": "@n", "fullTextUrlList": {"fullTextUrl": [{"url": "f"}, {"url": "g"}]}}, {"id": "2", "source": "PPR", "title": "U"}]}},
    ),
    "arxiv": ("<feed><entry><id>http://arxiv.org/abs/@id</id><title>A\n  @title</title><summary>@text &amp;amp; T</summary></entry><entry><id>http://arxiv.org/abs/2</id><title>C</title><summary></summary></entry></feed>",),
}
PAGES = {
    "fxtwitter": ({"tweet": {"text": "hi\n@text", "likes": "@n", "retweets": 1, "author": {"name": "@title"}}}, {"tweet": {"text": "no author"}}),
    "snippet": ({"unread": 1},),
    "mediawiki": ({"query": {"pages": [{"extract": "Born[1] in @n.[23] @text [note]."}]}}, {"query": {"pages": [{"missing": True}]}}),
    "github": ("# @title\n\n- one **@text**\n![i](j) [l](u)\n```py\nx\n```\nend", "plain"),
    "arxiv": SEARCHES["arxiv"],
    "semanticscholar": ({"title": "@title", "abstract": "@text", "citationCount": "@n"}, {"title": "@title", "abstract": None}),
    "europepmc": ({"resultList": {"result": [{"title": "@title", "abstractText": "@text", "citedByCount": "@n", "fullTextUrlList": {"fullTextUrl": [{"availabilityCode": "OA", "url": "f/@id"}, {"availabilityCode": "S", "url": "no"}, {"availabilityCode": "F", "url": "g"}]}}]}}, {"resultList": {"result": []}}),
}
PAGE_METRICS = {"fxtwitter": ("likes", "retweets"), "semanticscholar": ("citations",), "europepmc": ("citations",)}
CONTENT = ("application/pdf", "Application/PDF; charset=x", "text/html", None, "application/x-pdf")
PAGE_URLS = (
    "https://twitter.com/a/status/@id?s=20", "https://x.com/b", "https://www.reddit.com/r/x", "https://en.wikipedia.org/wiki/A_(@id)?c#d",
    "https://de.wikipedia.org/wiki/A", "https://github.com/a/b@id/tree/main", "https://github.com/a", "https://arxiv.org/abs/1706.@idv1",
    "https://arxiv.org/pdf/@id.03762.pdf?x=1", "https://www.semanticscholar.org/paper/Some-Title/0a@id", "https://www.semanticscholar.org/paper/@id",
    "https://europepmc.org/article/MED/@id", "https://europepmc.org/", "https://example.org/@id", "bad url",
)


def _text(payload) -> str | None:
    """The template of a payload; a number stands for itself, without quotes."""
    return payload if payload is None or isinstance(payload, str) else json.dumps(payload, ensure_ascii=False).replace('"@n"', "@n")


def search_templates(source: str) -> list[str | None]:
    return [_text(p) for p in (*SEARCHES[source], *NO_HITS)]


def page_templates(method: str) -> list[str | None]:
    return [_text(p) for p in (*PAGES[method], *NO_HITS[1:3], None)]


def pick(templates: Sequence[str | None], number: Column) -> Column:
    """The template of a row's number."""
    return F.element_at(F.array(*(F.lit(t).cast("string") for t in templates)), (F.pmod(number, F.lit(len(templates))) + 1).cast("int"))


def filled(templates: Sequence[str | None]) -> Column:
    """Each document's payload."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), UNSAFE, " ")
    out = pick(templates, F.col("doc_id"))
    for mark, value in (("@id", F.col("doc_id").cast("string")), ("@n", F.coalesce("n_chars", F.lit(0)).cast("string")), ("@title", F.regexp_extract(text, TITLE, 0)), ("@text", text)):
        out = F.replace(out, F.lit(mark), value)
    return out


def metrics_of(source: str) -> tuple[str, ...]:
    return tuple(decoders.SHAPES[source].metrics) if source in decoders.SHAPES else ()


def _search(source: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        payloads = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("query_id"), filled(search_templates(source)).alias("payload"))
        rows = decoders.decode_results(payloads, source)
        counts = [F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics_of(source)]
        return rows.select("query_id", "rank", "url", "title", "snippet", "oa_url", *counts)

    return run


def _page(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), filled(page_templates(method)).alias("raw"), F.col("source").alias("snippet"))
        counts = [F.try_element_at(decoders.page_metrics(F.col("raw"), F.lit(method)), F.lit(m)).alias(m) for m in PAGE_METRICS.get(method, ())]
        if method == "europepmc":
            counts.append(F.array_join(decoders.page_links(F.col("raw"), F.lit(method)), " ").alias("links"))
        return rows.select("id", decoders.decode_page(F.col("raw"), F.col("snippet"), F.lit(method)).alias("body"), *counts)

    return run


def pdf_skip(spark: SparkSession, d: str) -> DataFrame:
    """The pages with a type of content each, without PDFs, as where no extractor is there."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), pick(CONTENT, F.col("page_id")).alias("content_type"))
    return filters.skip_pdf(rows, False).select("id")


def api_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the interfaces for each page, as if it stood below a host with one."""
    url = F.replace(pick(PAGE_URLS, F.col("page_id")), F.lit("@id"), F.col("page_id").cast("string"))
    rows = routing.route(table(spark, d, "pages").select(F.col("page_id").alias("id"), url.alias("url")))
    return rows.select("id", pages.api_address(F.col("url"), F.col("method")).alias("address"))


def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    """What is asked for every row of ``pages``, and of the archive where that fails."""
    rows = routing.route(table(spark, d, "pages").select("page_id", "url"))
    return rows.select("page_id", pages.api_address(F.col("url"), F.col("method")).alias("address"), pages.archive_address(F.col("url")).alias("archive"))


def queries() -> dict[str, Query]:
    return {
        **{f"decode_{s}": _search(s) for s in SEARCHES},
        **{f"page_{m}": _page(m) for m in PAGES},
        "pdf_skip": pdf_skip,
        "api_addresses": api_addresses,
        "page_addresses": page_addresses,
    }
