"""Pages of results, fetched on the executors: addresses by route, tasks by host, threads within a task.

``fetch`` names a function ``module:name`` that takes an address and gives the
payload as text; the default asks with a plain request. Nothing here evades
access control.
"""

from __future__ import annotations

import importlib
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from http.client import HTTPException

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.functions.urls import host
from fernwalk.operators.routing import route

RAW_SCHEMA = "url string, raw string, error_class string, elapsed_ms int"
#: Addresses that a task asks at a time, and tasks that the addresses of one host are dealt to.
THREADS, LANES = 8, 1


def api_address(url: Column, method: Column) -> Column:
    """The address that is asked for a page: its interface's where the route has one; null where nothing is fetched."""
    part = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    of = lambda pattern, before, after="": F.concat(F.lit(before), part(pattern), F.lit(after))
    repository = F.concat(F.lit("https://api.github.com/repos/"), part(r"^https?://[^/]+/([^/?#]+/[^/?#]+)"), F.lit("/readme"))
    article = r"^https?://[^/]+/article/{}"
    known = (
        F.when(method == "fxtwitter", of(r"^https?://[^/]+/([^/?#]+/status/\d+)", "https://api.fxtwitter.com/"))
        .when(method == "mediawiki", of(r"^https?://[^/]+/wiki/([^?#]+)", "https://en.wikipedia.org/w/api.php?action=query&prop=extracts&explaintext=1&redirects=1&format=json&formatversion=2&titles="))
        .when(method == "github", repository)
        .when(method == "arxiv", of(r"^https?://[^/]+/(?:abs|pdf|html)/([^?#]+?)(?:\.pdf)?(?:[?#].*)?$", "https://export.arxiv.org/api/query?id_list="))
        .when(method == "semanticscholar", of(r"^https?://[^/]+/paper/(?:[^/?#]+/)?([^/?#]+)", "https://api.semanticscholar.org/graph/v1/paper/", "?fields=title,abstract,citationCount"))
        .when(method == "europepmc", F.concat(of(article.format(r"[^/?#]+/([^/?#]+)"), "https://www.ebi.ac.uk/europepmc/webservices/rest/search?format=json&resultType=core&query=ext_id:"), of(article.format(r"([^/?#]+)/[^/?#]+"), "%20src:")))
    )
    return F.when(method == "snippet", F.lit(None).cast("string")).otherwise(F.coalesce(known, url))


def archive_address(url: Column) -> Column:
    """Where the web archive keeps its latest copy of a page."""
    return F.concat(F.lit("https://web.archive.org/web/2id_/"), url)


def http_get(address: str) -> str:
    accept = "application/vnd.github.raw+json" if address.startswith("https://api.github.com/") else "*/*"
    asked = urllib.request.Request(address, headers={"User-Agent": "fernwalk", "Accept": accept})
    with urllib.request.urlopen(asked, timeout=30) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def _attempt(get, address: str) -> tuple[str | None, str | None, int]:
    begun = time.monotonic()
    try:
        raw, error = get(address), None
    except (OSError, ValueError, LookupError, HTTPException) as e:
        raw, error = None, type(e).__name__
    return raw, error, int(1000 * (time.monotonic() - begun))


def fetch_addresses(asked: DataFrame, fetch: str | None = None, threads: int = THREADS, lanes: int = LANES) -> DataFrame:
    """``(url, raw, error_class, elapsed_ms)`` for ``asked(url, address)``, one attempt a row.

    The rows of a host lie in ``lanes`` partitions, so at most ``lanes * threads``
    requests reach it at once; more lanes spread a host that has most rows. What an
    attempt that failed raised is told, null addresses fail as ``no_address``. A
    lost task asks its addresses again: write the result before it is used twice.
    """
    module, _, name = (fetch or "fernwalk.sources.pages:http_get").partition(":")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = getattr(importlib.import_module(module), name)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                # A few rows at a time, so that a task holds as many payloads as it has threads.
                for at in range(0, batch.num_rows, threads):
                    urls, addresses = (c.to_pylist() for c in batch.slice(at, threads).columns)
                    got = list(pool.map(lambda a: (None, "no_address", 0) if a is None else _attempt(get, a), addresses))
                    raws, errors, took = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(urls, pa.string()), pa.array(raws, pa.string()), pa.array(errors, pa.string()), pa.array(took, pa.int32())],
                        names=["url", "raw", "error_class", "elapsed_ms"],
                    )

    lane = F.pmod(F.xxhash64("url"), F.lit(lanes))
    rows = asked.select("url", "address").repartition(host(F.coalesce("address", "url")), lane)
    return rows.mapInArrow(run, RAW_SCHEMA)


def fetch_raw(results: DataFrame, fetch: str | None = None, threads: int = THREADS, lanes: int = LANES) -> DataFrame:
    """What the distinct pages of ``results(url)`` gave, each asked by its route; routes by snippet aren't asked."""
    routed = route(results.select("url").where("url IS NOT NULL").distinct())
    asked = routed.select("url", api_address(F.col("url"), F.col("method")).alias("address")).where("address IS NOT NULL")
    return fetch_addresses(asked, fetch, threads, lanes)


def fetch_archive(raw: DataFrame, fetch: str | None = None, threads: int = THREADS, lanes: int = LANES) -> DataFrame:
    """``(url, raw)`` of the archive's copies for those rows of ``raw`` that gave nothing; ``raw`` should be written first."""
    missing = raw.where("raw IS NULL OR raw = ''").select("url", archive_address(F.col("url")).alias("address"))
    return fetch_addresses(missing, fetch, threads, lanes).where("raw IS NOT NULL").select("url", "raw")
