"""Quality rules with cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed together with their host, and the documents that hold
each are counted. Lines in more documents than the limit are removed; a document
that loses most of its words is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.llm.common import SPACE, checked_broadcast, cut

#: A line is removed if it is in this many documents of its host at least, and either in more than one in MAX_SHARE of them
#: or in more than MAX_DOCS, whatever the size of the host.
MIN_DOCS, MAX_SHARE, MAX_DOCS = 3, 20, 10_000
#: A document is depleted if it keeps less than this percentage of its words, or fewer words than the base rules want.
KEEP_PERCENT = 50
#: Base rules: least number of words, words of a window, most per cent of words in repeated windows.
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30

_GAP, _WORD = f"[{SPACE}]+", f"[^{SPACE}]"


def _lines(text: str) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(_WORD)))


def _host_key(host: Column) -> Column:
    return F.xxhash64(F.coalesce(host.cast("string"), F.lit("")), host.isNull())


def _keys(lines: Column, host: Column) -> Column:
    """A key of host and normalised line, and the line's words, for each line."""
    flat = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.lower(x), _GAP, " ")))
    return F.transform(
        flat,
        lambda x: F.struct(F.xxhash64(F.coalesce(host.cast("string"), F.lit("")), host.isNull(), x).alias("key"), F.size(F.split(x, " ")).alias("n")),
    )


def _with_windows(df: DataFrame, hashes: str) -> DataFrame:
    """``df`` with an array of word hashes made one of the hashes of all windows of WINDOW words.

    Hashes of one, two and four words are paired in turn. Each step is a projection
    of its own, so none is computed again for each use in the next.
    """
    step = 1
    while step < WINDOW:
        df = df.withColumn(hashes, _paired(hashes, step))
        step *= 2
    return df.withColumn(hashes, F.slice(hashes, F.lit(1), F.size(hashes) - (WINDOW - 1)))


def _paired(hashes: str, step: int) -> Column:
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, host, lines)``, a row for each of ``docs``.

    Windows are compared by 64-bit hashes within one text. Only texts in which
    two are equal have them sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("_host"),
        text.alias("_text"),
        F.array_remove(F.split(text, _GAP), "").alias("_words"),
        _lines(text_col).alias("_lines"),
    )
    hashed = split.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _host_key(F.col("_host")).alias("host"),
        _keys(F.col("_lines"), F.col("_host")).alias("lines"),
        F.when(F.size("_words") >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).alias("_h"),
    )
    hashed = _with_windows(hashed, "_h")
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    ranked = hashed.withColumn(
        "_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    same = lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"])
    placed = ranked.withColumn(
        "_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])))
    )
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.when(F.col("_p").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x))
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "host", "lines")


def frequent_lines(base: DataFrame, min_docs: int = MIN_DOCS, max_share: int = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """``(key)`` of the lines of ``base(host, lines)`` that stand in too many rows of their host.

    A row counts a line once. The share acts alike on small and large hosts; the
    number keeps a large host from having lines in any number of documents.
    """
    often = (
        base.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("rows"), F.min("host").alias("host"))
        .where(F.col("rows") >= min_docs)
    )
    hosts = base.groupBy("host").agg(F.count("*").alias("all"))
    return often.join(hosts, "host").where((F.col("rows") * max_share > F.col("all")) | (F.col("rows") > max_docs)).select("key")


def quality(
    docs: DataFrame, min_docs: int = MIN_DOCS, max_share: int = MAX_SHARE, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Base counts, ``base_failed``, ``n_removed_words`` and ``kept``, one row for each row of ``docs``.

    Every row is a document of its own, so repeated rows are counted and judged
    each. Null and empty texts have no words and fail. Null hosts are one host.
    Null ids stay, other columns are ignored, and an empty table gives an empty
    result. Texts are read once; keys and counts go to the shared folder.
    Very long texts are counted whole, line by line.
    """
    base = cut(base_columns(docs, id_col, text_col, host_col).withColumn("_row", F.monotonically_increasing_id()))
    frequent = checked_broadcast(cut(frequent_lines(base, min_docs, max_share, max_docs)))
    lines = base.select("_row", F.explode("lines").alias("line")).select("_row", "line.key", "line.n")
    removed = lines.join(frequent, "key").groupBy("_row").agg(F.sum("n").cast("long").alias("_n"))
    judged = base.drop("lines", "host").join(removed, "_row", "left").withColumn("n_removed_words", F.coalesce("_n", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    enough = (100 * left >= KEEP_PERCENT * F.col("n_words")) & (left >= MIN_WORDS)
    return judged.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & enough).alias("kept"), "n_removed_words",
    )
