"""HTML extraction: the main text of pages, block by block, as a recurrent network labels them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fernwalk.llm.block_labeller import Weights, label_pages, trained
from fernwalk.llm.common import map_columns
from fernwalk.llm.html_blocks import blocks

#: A block at least this likely is part of the article.
THRESHOLD = 0.5


def extract_text(
    pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(id, url, text, n_chars)``, one row for each row of ``pages``.

    The text is the article's blocks in page order, joined by a line feed. It is
    empty for null and empty pages and for those in which no block is labelled
    as article. Repeated rows, null ids and null URLs stay, other columns are
    ignored, and an empty table gives an empty result.
    Very long pages are read whole.
    """
    weights = weights or trained()

    def start():
        known: dict = {}

        def work(rows):
            found = [blocks(h) for h in rows[html_col]]
            texts = [
                "\n".join(b.text for b, p in zip(page, likely, strict=True) if p >= THRESHOLD)
                for page, likely in zip(found, label_pages(found, weights, known), strict=True)
            ]
            return {id_col: rows[id_col], url_col: rows[url_col], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", text string, n_chars long"
    return map_columns(pages.select(id_col, url_col, html_col), start, schema)
