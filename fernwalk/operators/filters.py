"""Filters on hosts, fetch results, content types and sentence lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.constants import BLOCKED
from fernwalk.functions.urls import host, suffixes, within


def drop_blocked(df: DataFrame, domains: tuple[str, ...] | list[str] = BLOCKED, url: str = "url") -> DataFrame:
    """Without rows whose host is one of ``domains`` or below one; rows without a host stay."""
    return df.where(~within(host(F.col(url)), domains))


def drop_blocked_by_table(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """As ``drop_blocked``, for a list too long to be written into the plan.

    The distinct hosts are joined with ``domains(domain)`` on the domains above each,
    and the rows with the few that are blocked; rows with their columns are only
    shuffled if those are many.
    """
    at = F.col("_row")[url]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    hosts = rows.select(host(at).alias("_host")).where("_host IS NOT NULL").distinct()
    above = hosts.select("_host", F.explode(suffixes(F.col("_host"))).alias("domain"))
    hit = above.join(domains.select("domain").distinct(), "domain", "left_semi").select("_host").distinct()
    return rows.withColumn("_host", host(at)).join(hit, "_host", "left_anti").select("_row.*")


def ok_only(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("ok"), F.lit(False)))


def skip_pdf(df: DataFrame, available: bool, content_type: str = "content_type") -> DataFrame:
    """Without PDFs if no extractor is there; the flag is a constant that the optimiser folds."""
    is_pdf: Column = F.coalesce(F.lower(F.col(content_type)).contains("pdf"), F.lit(False))
    return df.where(F.lit(available) | ~is_pdf)


def min_length(sentences: DataFrame, n: int, s: str = "s") -> DataFrame:
    return sentences.where(F.length(s) >= n)
