"""Payloads of search services and page interfaces, decoded to common records.

A service is described by the schema of its answer, the list of its hits, and an
expression for each field; the rest is shared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.functions import text as T

RESULT_SCHEMA = "query_id string, source string, rank int, url string, title string, snippet string, metrics map<string,double>, oa_url string"


@dataclass(frozen=True)
class Shape:
    """``schema`` of the payload, ``hits`` the list in it, and SQL for the fields of one hit ``h``."""

    schema: str
    hits: str
    url: str
    title: str
    snippet: str = "CAST(NULL AS STRING)"
    oa_url: str = "CAST(NULL AS STRING)"
    metrics: dict[str, str] = field(default_factory=dict)


_PLAIN = Shape("results array<struct<url:string,title:string,snippet:string>>", "p.results", "h.url", "h.title", "h.snippet")
SHAPES = {
    "web": _PLAIN,
    "web_fallback": _PLAIN,
    "news": _PLAIN,
    "discussions": _PLAIN,
    "openalex": Shape(
        "results array<struct<id:string,display_name:string,cited_by_count:double,open_access:struct<is_oa:boolean,oa_url:string>>>",
        "p.results", "h.id", "h.display_name", oa_url="h.open_access.oa_url", metrics={"citations": "h.cited_by_count"},
    ),
    "semanticscholar": Shape(
        "data array<struct<url:string,title:string,abstract:string,citationCount:double,openAccessPdf:struct<url:string>>>",
        "p.data", "h.url", "h.title", "h.abstract", "h.openAccessPdf.url", {"citations": "h.citationCount"},
    ),
    "pubmed": Shape(
        "esearchresult struct<idlist:array<string>>", "p.esearchresult.idlist", "concat('https://pubmed.ncbi.nlm.nih.gov/', h, '/')", "h"
    ),
    "europepmc": Shape(
        "resultList struct<result:array<struct<id:string,source:string,title:string,abstractText:string,citedByCount:double,"
        "fullTextUrlList:struct<fullTextUrl:array<struct<url:string>>>>>>",
        "p.resultList.result", "concat('https://europepmc.org/article/', h.source, '/', h.id)", "h.title", "h.abstractText",
        "get(h.fullTextUrlList.fullTextUrl, 0).url", {"citations": "h.citedByCount"},
    ),
    "hackernews": Shape(
        "hits array<struct<objectID:string,title:string,url:string,story_text:string,points:double,num_comments:double>>",
        "p.hits", "coalesce(h.url, concat('https://news.ycombinator.com/item?id=', h.objectID))", "h.title", "h.story_text",
        metrics={"points": "h.points", "comments": "h.num_comments"},
    ),
    "stackoverflow": Shape(
        "items array<struct<link:string,title:string,body:string,score:double,answer_count:double>>",
        "p.items", "h.link", "h.title", "h.body", metrics={"score": "h.score", "answers": "h.answer_count"},
    ),
    "devto": Shape(
        "results array<struct<url:string,title:string,description:string,positive_reactions_count:double>>,"
        "result array<struct<path:string,title:string,public_reactions_count:double,highlight:struct<body_text:array<string>>>>",
        "coalesce(p.results, transform(p.result, r -> named_struct('url', concat('https://dev.to', r.path), 'title', r.title,"
        " 'description', get(r.highlight.body_text, 0), 'positive_reactions_count', r.public_reactions_count)))",
        "h.url", "h.title", "h.description", metrics={"reactions": "h.positive_reactions_count"},
    ),
    "github": Shape(
        "items array<struct<html_url:string,full_name:string,description:string,stargazers_count:double>>",
        "p.items", "h.html_url", "h.full_name", "h.description", metrics={"stars": "h.stargazers_count"},
    ),
}
#: Sources that search the web.
WEB_SOURCES = ("web", "web_fallback", "news", "discussions")
#: By what each source's hits are put in order before they are capped; the others keep their own order.
ORDER_BY = {"europepmc": "citations", "github": "stars"}


def decode_results(payloads: DataFrame, source: str) -> DataFrame:
    """Records of RESULT_SCHEMA from ``payloads(query_id, payload)`` of one source. A payload that can't be read has none.

    Payloads of web searches may also be result pages or feeds, those of PubMed records in XML.
    """
    if source == "arxiv":
        return _decode_atom(payloads)
    shaped = _decode_json(payloads, source)
    if source in WEB_SOURCES:
        return shaped.unionByName(_decode_result_page(payloads, source)).unionByName(_decode_feed(payloads, source))
    return shaped.unionByName(_decode_pubmed(payloads)) if source == "pubmed" else shaped


def _decode_json(payloads: DataFrame, source: str) -> DataFrame:
    shape = SHAPES[source]
    # Some services answer with a bare list.
    text = F.when(F.startswith(F.ltrim("payload"), F.lit("[")), F.concat(F.lit('{"results":'), "payload", F.lit("}"))).otherwise(F.col("payload"))
    rows = payloads.select("query_id", F.from_json(text, shape.schema).alias("p")).select(
        "query_id", F.posexplode(F.expr(shape.hits)).alias("rank", "h")
    )
    return rows.select(
        "query_id", F.lit(source).alias("source"), F.col("rank") + 1, F.expr(shape.url), F.expr(shape.title), F.expr(shape.snippet),
        _metrics(shape.metrics), F.expr(shape.oa_url),
    ).toDF(*(x.split()[0] for x in RESULT_SCHEMA.split(", ")))


def _metrics(named: dict[str, str]) -> Column:
    if not named:
        return F.lit(None).cast("map<string,double>")
    return F.create_map(*(x for k, v in named.items() for x in (F.lit(k), F.expr(v))))


def _records(pieces: DataFrame, source: str, url: Column, title: Column, snippet: Column, oa_url: Column) -> DataFrame:
    """Records of RESULT_SCHEMA from ``pieces(query_id, rank, e)``, whose ranks begin at 0."""
    return pieces.select(
        "query_id", F.lit(source).alias("source"), (F.col("rank") + 1).alias("rank"), url.alias("url"), title.alias("title"),
        snippet.alias("snippet"), F.lit(None).cast("map<string,double>").alias("metrics"), oa_url.alias("oa_url"),
    )


def _plain(markup: Column) -> Column:
    """Markup without tags, white space as one space, references decoded."""
    return T.decode_entities(F.trim(F.regexp_replace(F.regexp_replace(markup, r"<[^>]+>", ""), r"\s+", " ")))


def _decode_atom(payloads: DataFrame) -> DataFrame:
    entries = F.regexp_extract_all("payload", F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))
    rows = payloads.select("query_id", F.posexplode(entries).alias("rank", "e"))
    get = lambda tag: T.decode_entities(F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " ")))
    return _records(rows, "arxiv", get("id"), get("title"), get("summary"), get("id"))


def _decode_pubmed(payloads: DataFrame) -> DataFrame:
    """Titles and abstracts of article records; the parts of an abstract are joined by a space."""
    articles = F.regexp_extract_all("payload", F.lit(r"(?s)<PubmedArticle[ >].*?</PubmedArticle>"), F.lit(0))
    rows = payloads.select("query_id", F.posexplode(articles).alias("rank", "e"))
    number = F.regexp_extract("e", r"<PMID[^>]*>(\d+)</PMID>", 1)
    title = F.regexp_extract("e", r"(?s)<ArticleTitle[^>]*>(.*?)</ArticleTitle>", 1)
    parts = F.regexp_extract_all("e", F.lit(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), F.lit(1))
    url = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), number, F.lit("/"))
    abstract = F.nullif(_plain(F.array_join(parts, " ")), F.lit(""))
    return _records(rows, "pubmed", url, _plain(title), abstract, F.lit(None).cast("string"))


def _decode_result_page(payloads: DataFrame, source: str) -> DataFrame:
    """Hits of a web search's page of results: links are taken out of their redirections, advertisements are left out."""
    after = F.split("payload", 'class="result__a"')
    rows = payloads.select("query_id", F.posexplode(F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0)))).alias("rank", "e"))
    link = T.decode_entities(F.regexp_extract("e", r'href="([^"]*)"', 1))
    target = F.regexp_extract(link, r"[?&]uddg=([^&]+)", 1)
    url = F.when(target != "", F.try_url_decode(target)).otherwise(F.regexp_replace(link, "^//", "https://"))
    title = _plain(F.regexp_extract("e", r"(?s)>(.*?)</a>", 1))
    snippet = F.nullif(_plain(F.regexp_extract("e", r'(?s)class="result__snippet"[^>]*>(.*?)</a>', 1)), F.lit(""))
    return _records(rows.where(~link.contains("duckduckgo.com/y.js")), source, url, title, snippet, F.lit(None).cast("string"))


def _decode_feed(payloads: DataFrame, source: str) -> DataFrame:
    """The items of an RSS feed."""
    items = F.regexp_extract_all("payload", F.lit(r"(?s)<item[ >].*?</item>"), F.lit(0))
    rows = payloads.select("query_id", F.posexplode(items).alias("rank", "e"))
    raw = lambda tag: F.regexp_extract("e", rf"(?s)<{tag}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)
    snippet = F.nullif(_plain(raw("description")), F.lit(""))
    return _records(rows, source, _plain(raw("link")), _plain(raw("title")), snippet, F.lit(None).cast("string"))


def decode_page(raw: Column, snippet: Column, method: Column) -> Column:
    """The text of a page from what its fetch method returned; null where that can't be read."""
    field_of = lambda path: F.get_json_object(raw, path)
    joined = lambda *paths: F.concat_ws("\n", *map(field_of, paths))
    atom = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(raw, rf"(?s)<entry>.*?<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    from fernwalk.functions.html import extract_article

    text = (
        F.when(method == "fxtwitter", joined("$.tweet.author.name", "$.tweet.text"))
        .when(method == "snippet", snippet)
        .when(method == "mediawiki", T.strip_citations(field_of("$.query.pages[0].extract")))
        .when(method == "github", T.strip_markdown(raw))
        .when(method == "arxiv", F.concat_ws("\n", atom("title"), atom("summary")))
        .when(method == "semanticscholar", joined("$.title", "$.abstract"))
        .when(method == "europepmc", joined("$.resultList.result[0].title", "$.resultList.result[0].abstractText"))
        .otherwise(extract_article(raw))
    )
    return F.nullif(text, F.lit(""))


def page_metrics(raw: Column, method: Column) -> Column:
    """Counts that a page's interface gives beside its text."""
    number = lambda path: F.get_json_object(raw, path).try_cast("double")
    return (
        F.when(method == "fxtwitter", F.create_map(F.lit("likes"), number("$.tweet.likes"), F.lit("retweets"), number("$.tweet.retweets")))
        .when(method == "semanticscholar", F.create_map(F.lit("citations"), number("$.citationCount")))
        .when(method == "europepmc", F.create_map(F.lit("citations"), number("$.resultList.result[0].citedByCount")))
    )


def page_links(raw: Column, method: Column) -> Column:
    """Addresses of the full text that a page's interface gives beside its abstract, open ones; null where it gives none."""
    record = "struct<resultList:struct<result:array<struct<fullTextUrlList:struct<fullTextUrl:array<struct<availabilityCode:string,url:string>>>>>>>"
    listed = F.get(F.from_json(raw, record)["resultList"]["result"], F.lit(0))["fullTextUrlList"]["fullTextUrl"]
    open_ = F.transform(F.filter(listed, lambda x: F.coalesce(x["availabilityCode"], F.lit("OA")).isin("OA", "F")), lambda x: x["url"])
    return F.when((method == "europepmc") & (F.size(open_) > 0), open_)
