"""From a query and fetched pages to the few sentences that answer it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.constants import BLOCKED, BUDGET, LAMBDA
from fernwalk.functions.density import extract_dense
from fernwalk.functions.html import extract_article
from fernwalk.operators.compress import select_within_budget
from fernwalk.operators.filters import drop_blocked, min_length
from fernwalk.operators.rank import bm25, centrality, combine
from fernwalk.operators.running import select_within_total
from fernwalk.operators.sentences import dedup_across_pages, sentences


def query_terms(query: str) -> list[str]:
    """The distinct words of a query, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W\d_]+", query.lower())))


def compress(pages: DataFrame, terms: list[str], budget: int = BUDGET, lam: float = LAMBDA, blocked: tuple[str, ...] = BLOCKED, shortest: int = 1, strategy: str = "prefix", extract: Callable[[Column], Column] = extract_article) -> DataFrame:
    """``(doc_id, pos, s, score)``: sentences of ``pages(page_id, url, html)`` that fit each page's budget, or one that all share.

    Pages come in the order of their ids; a sentence counts for the first that has it.
    ``strategy`` is ``prefix`` or ``skip`` for the budget of a page, ``total`` for
    one budget over the whole answer.
    """
    kept = drop_blocked(pages, blocked)
    texts = kept.select(F.col("page_id").alias("doc_id"), extract(F.col("html")).alias("text"))
    return compress_texts(texts, terms, budget, lam, shortest, strategy)


def compress_texts(texts: DataFrame, terms: list[str], budget: int = BUDGET, lam: float = LAMBDA, shortest: int = 1, strategy: str = "prefix") -> DataFrame:
    """The same for ``texts(doc_id, text)``, whose ids give their order."""
    rows = min_length(dedup_across_pages(sentences(texts), ["doc_id", "pos"]), shortest)
    scored = combine(rows, bm25(rows, terms, ["doc_id", "pos"]), centrality(rows), lam)
    taken = select_within_total(scored, budget) if strategy == "total" else select_within_budget(scored, budget, strategy)
    return taken.select("doc_id", "pos", "s", "score")


def search(pages: DataFrame, query: str, budget: int = BUDGET, lam: float = LAMBDA, blocked: tuple[str, ...] = BLOCKED, strategy: str = "prefix") -> DataFrame:
    """The sentences for a query in reading order; of a page without a marked article the densest run is read."""
    return compress(pages, query_terms(query), budget, lam, blocked, strategy=strategy, extract=extract_dense).orderBy("doc_id", "pos")
