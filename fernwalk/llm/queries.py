"""The queries of the operators in this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwalk.llm.common import table
from fernwalk.llm.decontamination import find_leaks
from fernwalk.llm.html_extract import extract_text
from fernwalk.llm.lexical_search import rank_documents
from fernwalk.llm.license_templates import scan_licenses
from fernwalk.llm.line_frequency import quality
from fernwalk.llm.lsh_forest import near_duplicates as forest_near_duplicates
from fernwalk.llm.mixing import mix
from fernwalk.llm.secret_scan import find_secrets
from fernwalk.llm.simhash import near_duplicates
from fernwalk.llm.source_divergence import divergences
from fernwalk.llm.toxicity import learn, score_toxicity
from fernwalk.llm.url_filters import judge_urls
from fernwalk.llm.warc import archive


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive(table(spark, sf_dir, "pages"))
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_literal"
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_near_duplicates(table(spark, sf_dir, "documents"))


ALL = (
    op1_warc_bundles,
    op2_decontamination,
    op3_toxicity,
    op4_line_frequency,
    op5_secret_scan,
    op6_source_mixing,
    op7_simhash_dedup,
    op8_license_templates,
    op9_url_filters,
    op10_html_extract,
    op11_lexical_search,
    op12_source_divergence,
    op13_lsh_forest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from fernwalk.llm.oracles import ORACLES

    return ORACLES
