"""The main text of a page without a marked article, by the density of its words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernwalk.functions.html import UNSEEN, article_html, text_of

#: Tags, and the text between them.
TOKEN = r"<[^>]*>|[^<]+|<"
#: What a word adds and a tag takes away.
WORD_GAIN, TAG_LOSS = 2, 7


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(html, UNSEEN, " "), F.lit(TOKEN), F.lit(0))


def weight(token: Column) -> Column:
    words = F.regexp_count(token, F.lit(r"[^ \t\n\r]+"))
    return F.when(F.startswith(token, F.lit("<")) & (F.length(token) > 1), -TAG_LOSS).otherwise(WORD_GAIN * words)


def densest(weights: Column) -> Column:
    """Where the run of the largest sum lies, as ``(best, start, end)`` from 1; ``best`` is 0 if no sum is positive.

    One pass: a sum that isn't positive is given up. Of runs of equal sums the one that ends first counts.
    """
    begin = F.struct(*(F.lit(0).alias(n) for n in ("i", "sum", "first", "best", "start", "end")))

    def step(acc: Column, w: Column) -> Column:
        fresh = acc["sum"] <= 0
        total = F.when(fresh, w).otherwise(acc["sum"] + w)
        first = F.when(fresh, acc["i"] + 1).otherwise(acc["first"])
        better = total > acc["best"]
        return F.struct(
            (acc["i"] + 1).alias("i"),
            total.alias("sum"),
            first.alias("first"),
            F.when(better, total).otherwise(acc["best"]).alias("best"),
            F.when(better, first).otherwise(acc["start"]).alias("start"),
            F.when(better, acc["i"] + 1).otherwise(acc["end"]).alias("end"),
        )

    return F.aggregate(weights, begin, step, lambda acc: F.struct(acc["best"].alias("best"), acc["start"].alias("start"), acc["end"].alias("end")))


def dense_html(html: Column) -> Column:
    """The run of tokens with the most words for its tags; null if the page has no word."""
    all_ = tokens(html)
    # The run is found once for each page and its bounds are used twice.
    found = F.transform(F.array(densest(F.transform(all_, weight))), lambda d: F.when(d["best"] > 0, F.array_join(F.slice(all_, d["start"], d["end"] - d["start"] + 1), "")))
    return found[0]


def extract_dense(html: Column) -> Column:
    """The marked article's text, or without one that of the densest run."""
    return text_of(F.coalesce(article_html(html), dense_html(html)))
