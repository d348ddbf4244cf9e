"""Search services as a Spark data source: a partition for each query and service.

``fetch`` names a function ``module:name`` that takes a source, a query and a
number of results and returns the payload; it runs on the executors. The default
asks the services' public addresses: one request each, PubMed's ids a second one
for their records. Nothing here evades access control.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fernwalk.sources.decoders import decode_results

#: Public addresses that need no key; ``{q}`` is the query, ``{n}`` the number of results.
ENDPOINTS = {
    "web": "https://html.duckduckgo.com/html/?q={q}",
    "web_fallback": "https://www.bing.com/search?format=rss&count={n}&q={q}",
    "news": "https://www.bing.com/news/search?format=rss&q={q}",
    "discussions": "https://html.duckduckgo.com/html/?q={q}%20site%3Areddit.com",
    "arxiv": "https://export.arxiv.org/api/query?search_query=all:{q}&max_results={n}&sortBy=relevance",
    "semanticscholar": "https://api.semanticscholar.org/graph/v1/paper/search?query={q}&limit={n}&fields=title,abstract,url,citationCount,openAccessPdf",
    "openalex": "https://api.openalex.org/works?search={q}&per-page={n}",
    "pubmed": "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&term={q}&retmax={n}",
    "europepmc": "https://www.ebi.ac.uk/europepmc/webservices/rest/search?query={q}&format=json&resultType=core&pageSize={n}&sort=CITED%20desc",
    "hackernews": "https://hn.algolia.com/api/v1/search?query={q}&tags=story&hitsPerPage={n}",
    "stackoverflow": "https://api.stackexchange.com/2.3/search/advanced?order=desc&sort=relevance&site=stackoverflow&filter=withbody&q={q}&pagesize={n}",
    "devto": "https://dev.to/search/feed_content?class_name=Article&per_page={n}&search_fields={q}",
    "github": "https://api.github.com/search/repositories?q={q}&sort=stars&per_page={n}",
}
#: PubMed's records of the ids that a search gave.
PUBMED_RECORDS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed&retmode=xml&id={ids}"


def http_fetch(source: str, query: str, n: int) -> str:
    payload = _get(address(source, query, n))
    if source == "pubmed":
        ids = json.loads(payload)["esearchresult"]["idlist"]
        return _get(PUBMED_RECORDS.format(ids=",".join(ids))) if ids else payload
    return payload


def address(source: str, query: str, n: int) -> str:
    """Where a source is asked for ``n`` results."""
    return ENDPOINTS[source].format(q=urllib.parse.quote(query), n=n)


def _get(url: str) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "fernwalk"}), timeout=30) as answer:
        return answer.read().decode("utf-8", "replace")


class _Ask(InputPartition):
    def __init__(self, query_id: str, text: str, source: str):
        self.query_id, self.text, self.source = query_id, text, source


class SearchSource(DataSource):
    """``format("fernwalk_search")`` with options ``asks`` (JSON list of query id, text and source), ``n`` and ``fetch``."""

    @classmethod
    def name(cls) -> str:
        return "fernwalk_search"

    def schema(self) -> str:
        return "query_id string, source string, payload string, error_class string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(dict(self.options))


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Ask(*ask) for ask in json.loads(self.options["asks"])]

    def read(self, partition: _Ask) -> Iterator[tuple]:
        module, _, name = self.options.get("fetch", "fernwalk.sources.connectors:http_fetch").partition(":")
        try:
            payload = getattr(importlib.import_module(module), name)(partition.source, partition.text, int(self.options.get("n", "5")))
            yield partition.query_id, partition.source, payload, None
        except (OSError, KeyError, ValueError) as e:
            yield partition.query_id, partition.source, None, type(e).__name__


def ask(spark: SparkSession, asks: list[tuple[str, str, str]], n: int = 5, fetch: str | None = None) -> DataFrame:
    """``(query_id, source, payload, error_class)`` for each query id, text and source; an attempt that failed has no payload and tells why."""
    spark.dataSource.register(SearchSource)
    reader = spark.read.format("fernwalk_search").option("asks", json.dumps(asks)).option("n", str(n))
    return (reader.option("fetch", fetch) if fetch else reader).load()


def read_payloads(spark: SparkSession, queries: list[tuple[str, str]], sources: list[str], n: int = 5, fetch: str | None = None) -> DataFrame:
    """Every query asked of every source."""
    return ask(spark, [(i, t, s) for i, t in queries for s in sources], n, fetch)


def read_source(spark: SparkSession, name: str, queries: list[tuple[str, str]], n: int = 5, fetch: str | None = None) -> DataFrame:
    """Decoded results of one source."""
    return decode_results(read_payloads(spark, queries, [name], n, fetch).select("query_id", "payload"), name)
