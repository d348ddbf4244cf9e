"""Abbreviations learned from a corpus, so that their stops don't end sentences (after Kiss and Strunk 2006).

A word that is an abbreviation all but always stands before a stop. Its occurrences
with and without one are counted over all texts; a log-likelihood ratio tells how much
better "nearly always" explains them than the rate of all words does. Long words, and
those also seen without a stop, count for less, stops within for more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwalk.functions import text as T

#: Words, stops within included, with the stop that follows, if one does.
TOKEN = r"(?:[\p{L}\p{M}]+\.)*[\p{L}\p{M}]+\.?"
#: How often an abbreviation has its stop, and the score from which a word is one.
ALWAYS, LEAST = 0.99, 0.3
#: Abbreviations that a pattern is made of; more are an error, as the list comes to the driver.
MOST = 5000
#: Stands for a stop that ends nothing, while texts are split.
_KEPT = ""


def stop_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, stopped, bare)``: how often each word has a stop behind it, and how often not."""
    tokens = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0))).alias("token"))
    stop = F.endswith("token", F.lit("."))
    word = F.when(stop, F.substr("token", F.lit(1), F.length("token") - 1)).otherwise(F.col("token"))
    return tokens.groupBy(word.alias("word")).agg(F.count_if(stop).alias("stopped"), F.count_if(~stop).alias("bare"))


def learn_abbreviations(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``(word, score)`` of the words whose score is ``least`` or more; null texts hold none."""
    counts = stop_counts(docs, text_col)
    whole = counts.agg(F.sum(F.col("stopped") + F.col("bare")).cast("double").alias("n"), F.sum("stopped").cast("double").alias("stops"))
    rate = F.col("stops") / F.col("n")
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    as_usual = F.col("stopped") * F.ln(rate) + F.when(F.col("bare") > 0, F.col("bare") * F.ln(1 - rate)).otherwise(0.0)
    always = F.col("stopped") * F.ln(F.lit(ALWAYS)) + F.col("bare") * F.ln(F.lit(1 - ALWAYS))
    penalty = F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -F.col("bare").cast("double"))
    # A word that always has its stop, as all words do, is no news.
    scored = counts.where("stopped > 0").crossJoin(F.broadcast(whole)).where("stops < n")
    return scored.select("word", F.round(-2 * (as_usual - always) * penalty, 9).alias("score")).where(F.col("score") >= least)


def words_of(abbreviations: DataFrame) -> list[str]:
    found = sorted(r[0] for r in abbreviations.select("word").limit(MOST + 1).collect())
    if len(found) > MOST:
        raise ValueError(f"over {MOST} abbreviations; ask for a higher score")
    return found


def sentences(text: Column, abbreviations: list[str]) -> Column:
    """``T.sentences`` in which the stop of an abbreviation ends nothing, but for line feeds."""
    if not abbreviations:
        return T.sentences(text)
    names = "|".join(a.replace(".", r"\.") for a in sorted(abbreviations, key=lambda a: (-len(a), a)))
    held = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{M}}.])({names})\.(?=[^\S\n]+)", f"$1{_KEPT}")
    return F.transform(T.sentences(held), lambda s: F.replace(s, F.lit(_KEPT), F.lit(".")))


def split_learned(docs: DataFrame, abbreviations: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, pos, s)`` like ``sentences.sentences``, with the abbreviations heeded."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col), abbreviations)).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.trim("s").alias("s")).where("s <> ''")
