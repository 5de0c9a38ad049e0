"""Page queries: H01-H06, A02, U01, S10."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import defaults
from ..functions.text import truncate_chars, word_count
from ..plans.pages import page_extract, page_report
from .common import table, word_count as sql_wc
from .documents import summary_ctes, wf_ctes
from .sqltext import page_cte, sentiment_ctes


def _extract(spark, sf):
    return page_extract(table(spark, sf, "pages"))


def q_page_title(spark, sf):
    return _extract(spark, sf).select("page_id", "title")


def _exploded(spark, sf, col, alias):
    return _extract(spark, sf).select(
        "page_id", F.posexplode(col).alias("pos", alias)).withColumn("pos", F.col("pos").cast("long"))


def q_page_headings(spark, sf):
    return _exploded(spark, sf, "headings", "heading")


def q_page_paragraphs(spark, sf):
    return _exploded(spark, sf, "paragraphs", "paragraph")


def q_page_links(spark, sf):
    return _exploded(spark, sf, "links", "link")


def q_page_text(spark, sf):
    ex = _extract(spark, sf)
    return ex.select("page_id", "text", F.length("text").cast("long").alias("full_chars"))


def q_word_count_truncated(spark, sf):
    """Words of the first 1024 characters (the cut is the operator)."""
    return _extract(spark, sf).select("page_id", word_count(truncate_chars("text", defaults.TEXT_BUDGET)).alias("word_count"))


def q_concat_lists(spark, sf):
    """Headings + paragraphs as one ordered list (duplicates kept)."""
    ex = _extract(spark, sf)
    return ex.select("page_id", F.posexplode(F.concat("headings", "paragraphs")).alias("pos", "item")) \
        .withColumn("pos", F.col("pos").cast("long"))


def q_scan_pages(spark, sf):
    """The fetched-page table as input: (page_id, url, host, n_bytes)."""
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", F.try_parse_url("url", F.lit("HOST")).alias("host"),
                    F.octet_length("html").cast("long").alias("n_bytes"))


def q_page_report(spark, sf):
    rep = page_report(table(spark, sf, "pages"))
    return rep.select(
        "page_id", "url", "title", "summary",
        F.size("headings").cast("long").alias("n_headings"),
        F.size("paragraphs").cast("long").alias("n_paragraphs"),
        F.size("links").cast("long").alias("n_links"),
        F.array_join("headings", "\n").alias("headings_text"),
        F.coalesce(F.array_join("top_terms", " "), F.lit("")).alias("terms"), "error",
        "word_count", "summary_budget",
        *[F.col(f"sentiment.{c}").alias(c) for c in
          ("polarity", "subjectivity", "positivity", "negativity", "neutrality", "compound")])


QUERIES = {
    "page_title": q_page_title,
    "page_headings": q_page_headings,
    "page_paragraphs": q_page_paragraphs,
    "page_links": q_page_links,
    "page_text": q_page_text,
    "word_count_truncated": q_word_count_truncated,
    "concat_lists": q_concat_lists,
    "scan_pages": q_scan_pages,
    "page_report": q_page_report,
}

_PE = page_cte("pages")


def _unnest_sql(col, alias):
    return f"""WITH {_PE}
SELECT page_id, (generate_subscripts({col}, 1) - 1)::BIGINT AS pos, unnest({col}) AS {alias} FROM pe"""


SQL = {
    "page_title": f"WITH {_PE} SELECT page_id, title FROM pe",
    "page_headings": _unnest_sql("headings", "heading"),
    "page_paragraphs": _unnest_sql("paragraphs", "paragraph"),
    "page_links": _unnest_sql("links", "link"),
    "page_text": f"WITH {_PE} SELECT page_id, text, length(text)::BIGINT AS full_chars FROM pe",
    "word_count_truncated": f"WITH {_PE} SELECT page_id, {sql_wc('substring(text, 1, 1024)')} AS word_count FROM pe",
    "concat_lists": _unnest_sql("list_concat(headings, paragraphs)", "item"),
    "scan_pages": """SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host,
  octet_length(encode(html))::BIGINT AS n_bytes FROM pages""",
    "page_report": f"""WITH {_PE}, {sentiment_ctes('pe', 'page_id', 'text')}, {summary_ctes('pe', 'page_id', 'text', 'least(floor(length(text) / 2), 100)')},
{wf_ctes(False, 'pe', 'page_id')},
tt AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS terms FROM wf WHERE rank <= {defaults.WORDCLOUD_MAX_WORDS} GROUP BY 1)
SELECT pe.page_id, url, title, summ.summary, len(headings)::BIGINT AS n_headings, len(paragraphs)::BIGINT AS n_paragraphs,
  len(links)::BIGINT AS n_links, array_to_string(headings, chr(10)) AS headings_text,
  coalesce(tt.terms, '') AS terms, CASE WHEN coalesce(text, '') = '' THEN 'No text found on the page.' END AS error,
  {sql_wc('text')} AS word_count, least(floor(length(text) / 2), {100})::BIGINT AS summary_budget,
  polarity, subjectivity, positivity, negativity, neutrality, compound
FROM pe JOIN senti ON pe.page_id = senti.id LEFT JOIN summ ON pe.page_id = summ.doc_id LEFT JOIN tt ON pe.page_id = tt.doc_id""",
}

assert defaults.TEXT_BUDGET == 1024
