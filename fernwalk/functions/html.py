"""Article text of HTML, by tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernwalk.functions.text import decode_entities

ARTICLE = r"(?is)<article(?:\s[^>]*)?>(.*?)</article>"
#: Content that is never text; scripts go before tags, as they may hold some in strings.
UNSEEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|br|h1|h2|h3|li|ul|ol|div|tr)(?:[\s/][^>]*)?>"
TAG = r"<[^>]+>"


def article_html(html: Column) -> Column:
    """What stands within the article element; null where there is none."""
    found = F.regexp_extract(html, ARTICLE, 1)
    return F.when(found != "", found)


def text_of(html: Column) -> Column:
    """Text with a line feed for each block-level tag, references decoded."""
    out = F.regexp_replace(html, UNSEEN, " ")
    out = F.regexp_replace(out, BREAKS, "\n")
    return F.trim(decode_entities(F.regexp_replace(out, TAG, "")))


def extract_article(html: Column) -> Column:
    """The article's text, or the whole page's where no article is marked."""
    return text_of(F.coalesce(article_html(html), html))
