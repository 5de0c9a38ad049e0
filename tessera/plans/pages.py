"""Web-page report (H01-H06) over a ``pages(page_id, url, html)`` table.

Physical plan: scan pages -> narrow regex projection (the raw HTML never
crosses a shuffle).  Sentiment, the summary and the word terms are worked out in
the row, so every page has its own, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults
from ..functions import html as H
from ..functions.text import bounded_length, word_count
from ..operators.sentiment import with_sentiment
from .documents import with_terms


def page_extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url?, title, headings, paragraphs, links, text)."""
    clean = H.content_html(html_col)
    keep = [c for c in pages.columns if c not in (html_col,)]
    ex = pages.select(*keep, clean.alias("_clean"))
    ex = ex.select(*keep,
                   H.page_title("_clean").alias("title"),
                   H.page_headings("_clean").alias("headings"),
                   H.page_paragraphs("_clean").alias("paragraphs"),
                   H.page_links("_clean").alias("links"))
    return ex.withColumn("text", H.page_text("headings", "paragraphs"))


def page_report(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                lexicon: DataFrame | None = None, with_summary: bool = True) -> DataFrame:
    """One D5 record per page.

    Columns: id, url, title, headings, paragraphs, links, text, word_count,
    summary_budget, summary (within the budget), top_terms, sentiment struct
    and error (a page without HTML)."""
    ex = page_extract(pages, id_col, html_col)
    ex = ex.withColumn("word_count", word_count("text")).withColumn("summary_budget", bounded_length("text"))
    out = with_sentiment(ex, "text", None, lexicon)
    if with_summary:
        out = with_terms(out, defaults.WORDCLOUD_MAX_WORDS, "summary_budget")
    names = ("polarity", "subjectivity", "positivity", "negativity", "neutrality", "compound")
    return out.select(*[c for c in out.columns if c not in names], F.struct(*names).alias("sentiment"),
                      F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(NO_TEXT)).alias("error"))


NO_TEXT = "No text found on the page."
