"""Pages for results: by route, with an archive to fall back on, and the text of PDFs."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwalk.operators.merge import coalesce_fetch
from fernwalk.operators.routing import route
from fernwalk.sources.decoders import decode_page, page_links, page_metrics


def fetch(results: DataFrame, raw: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """``(url, method, ok, error_class, body, metrics, links, elapsed_ms)`` for ``results(url, snippet)``.

    ``links`` are the open full texts that an article's record names.
    ``raw(url, raw, error_class, elapsed_ms)`` is what was fetched, one row a URL;
    ``archive(url, raw)`` fills in for URLs whose fetch gave nothing.
    """
    tried = route(results.select("url", "snippet").dropDuplicates(["url"])).join(raw, "url", "left")
    if archive is not None:
        tried = coalesce_fetch(tried, archive, columns=("raw",))
    body = decode_page(F.col("raw"), F.col("snippet"), F.col("method"))
    out = tried.withColumn("body", body).withColumn("ok", F.col("body").isNotNull())
    error = F.when(~F.col("ok"), F.coalesce("error_class", F.lit("empty")))
    return out.select("url", "method", "ok", error.alias("error_class"), "body", page_metrics(F.col("raw"), F.col("method")).alias("metrics"), page_links(F.col("raw"), F.col("method")).alias("links"), "elapsed_ms")


def pdf_extractor() -> bool:
    """Whether this machine has the program that reads PDFs."""
    return shutil.which("pdftotext") is not None


def pdf_text(df: DataFrame, available: bool | None = None) -> DataFrame:
    """``(url, body)`` of the PDFs in ``df(url, content)``; none if no extractor is there."""
    if not (pdf_extractor() if available is None else available):
        return df.select("url", F.lit(None).cast("string").alias("body")).where("false")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"url": part["url"], "body": [_one(c) for c in part["content"]]})

    return df.select("url", "content").mapInPandas(run, "url string, body string")


def _one(content: bytes | None) -> str | None:
    if not content:
        return None
    try:
        done = subprocess.run(["pdftotext", "-q", "-", "-"], input=bytes(content), capture_output=True, timeout=60, check=True)
    except (subprocess.SubprocessError, OSError):
        return None
    return done.stdout.decode("utf-8", "replace")
