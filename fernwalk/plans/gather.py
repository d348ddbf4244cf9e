"""From queries with flags to results of all their sources, and on to texts and sentences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernwalk.constants import BASE_SOURCES, BLOCKED, BUDGET, FLAG_SOURCES, LAMBDA, PER_SOURCE, TOP_RESULTS
from fernwalk.functions import text as T
from fernwalk.operators.filters import drop_blocked, ok_only
from fernwalk.operators.merge import merge_sources, prefer_open_access, top_per_source
from fernwalk.plans.search import compress_texts, query_terms
from fernwalk.sources.connectors import ask
from fernwalk.sources.decoders import ORDER_BY, decode_results
from fernwalk.sources.fetchers import fetch as fetch_pages
from fernwalk.storage import stored

#: Sources that are asked where another gave a query nothing.
FALLBACKS = {"web": "web_fallback", "arxiv": "semanticscholar"}

#: Sources whose results are told by their open-access address where they have one.
OPEN_ACCESS_FIRST = ("openalex",)


def sources_of(flags: list[str]) -> list[str]:
    """The sources of a query, each once."""
    return list(dict.fromkeys([*BASE_SOURCES, *(s for f, s in FLAG_SOURCES if f in flags)]))


def with_regions(queries: DataFrame) -> DataFrame:
    """``queries(query_id, text)`` with the language told by their script and its search region."""
    lang = T.detect_language(F.col("text"))
    return queries.withColumn("lang", lang).withColumn("region", T.region(F.col("lang")))


@dataclass(frozen=True)
class Gathered:
    """``results``, and in ``failures(query_id, source, error_class)`` the attempts that gave no answer."""

    results: DataFrame
    failures: DataFrame


def gather(spark: SparkSession, queries: list[tuple[str, str, list[str]]], fetch: str | None = None, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """The results of ``gather_all``."""
    return gather_all(spark, queries, fetch, blocked).results


def gather_all(spark: SparkSession, queries: list[tuple[str, str, list[str]]], fetch: str | None = None, blocked: tuple[str, ...] = BLOCKED) -> Gathered:
    """Results of ``queries`` (id, text, flags) from all their sources, capped, without blocked domains, and what failed.

    All sources are asked at once, a partition for each query and source. A
    fallback is asked only for the queries whose first source gave nothing; what
    comes to the driver for that is ids of the queries, which came from there.
    """
    asks = [(i, t, s) for i, t, flags in queries for s in sources_of(flags)]
    # Asking is costly and the answers are read once for each source, so they are written.
    answers = stored(ask(spark, asks, TOP_RESULTS, fetch))
    results, failed = _results(answers, asks), [answers]
    for first, second in FALLBACKS.items():
        asked = {i for i, _, s in asks if s == first}
        if asked:
            given = {r.query_id for r in results.where(F.col("source") == first).select("query_id").distinct().collect()}
            again = [(i, t, second) for i, t, _ in queries if i in asked - given]
            if again:
                more = stored(ask(spark, again, TOP_RESULTS, fetch))
                results = merge_sources(results, _results(more, again))
                failed.append(more)
    key = F.when(F.lit(False), F.lit(0.0))
    for source, metric in ORDER_BY.items():
        key = key.when(F.col("source") == source, -F.coalesce(F.try_element_at("metrics", F.lit(metric)), F.lit(0.0)))
    key = F.coalesce(key, F.col("rank").cast("double"))
    # Open-access addresses stand for those of works; papers of other sources keep the page that their route knows.
    open_works = F.when(F.col("source").isin(*OPEN_ACCESS_FIRST), F.col("oa_url"))
    kept = drop_blocked(prefer_open_access(results.withColumn("_oa", open_works), oa_url="_oa").drop("_oa"), blocked)
    web = F.col("source").isin("web", "web_fallback")
    by = ("query_id", "source")
    capped = merge_sources(
        top_per_source(kept.where(web), key, F.col("rank"), TOP_RESULTS, by), top_per_source(kept.where(~web), key, F.col("rank"), PER_SOURCE, by)
    )
    return Gathered(capped, merge_sources(*(a.where("error_class IS NOT NULL").select("query_id", "source", "error_class") for a in failed)))


def _results(payloads: DataFrame, asks: list[tuple[str, str, str]]) -> DataFrame:
    return merge_sources(*(decode_results(payloads.where(F.col("source") == s).select("query_id", "payload"), s) for s in dict.fromkeys(s for _, _, s in asks)))


def answer(results: DataFrame, raw: DataFrame, query: str, archive: DataFrame | None = None, budget: int = BUDGET, lam: float = LAMBDA, strategy: str = "prefix") -> DataFrame:
    """``(url, pos, s, score)``: sentences for one query from the pages of its ``results``.

    Pages come in the order of their sources and places; each URL counts once. With
    ``strategy`` ``total`` the budget is that of the whole answer.
    """
    order = Window.partitionBy("url").orderBy("source", "rk")
    once = results.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    bodies = ok_only(fetch_pages(once, raw, archive))
    texts = once.join(bodies, "url").select(F.concat_ws(" ", "source", F.lpad(F.col("rk").cast("string"), 6, "0"), "url").alias("doc_id"), "url", F.col("body").alias("text"))
    picked = compress_texts(texts.select("doc_id", "text"), query_terms(query), budget, lam, strategy=strategy)
    return picked.join(texts.select("doc_id", "url"), "doc_id").select("url", "pos", "s", "score")
