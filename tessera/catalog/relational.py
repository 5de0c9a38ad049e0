"""Relational / hook queries: S01, S08, S09, P06, P07, P10, U03, A15, F11, T08, Y01-Y03."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import defaults
from ..functions.text import feedback_format
from ..operators import infer as Y
from ..operators import relational as RL
from ..plans.documents import document_report
from ..plans.pages import page_report
from ..sources.files import SUFFIX_READERS, UNSUPPORTED, route_by_suffix
from .common import lit, table, values
from .documents import _SENTI, _SUMMARY_CTES, _WF_CTES, summary_ctes, wf_ctes
from .common import word_count as sql_wc
from .pages import _PE
from .retrieval import FEEDBACK_SQL, feedback_rows
from .sqltext import sentiment_ctes

EXTS = [".pdf", ".XLSX", ".csv", ".json", ".xml", ".docx", ".jpg", ".jpeg", ".PNG", ".dcm", ".txt", ".md"]


def q_route_by_suffix(spark, sf):
    d = table(spark, sf, "documents")
    exts = F.array(*[F.lit(e) for e in EXTS])
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"),
                    F.element_at(exts, (F.col("doc_id") % len(EXTS) + 1).cast("int")))
    return route_by_suffix(d.select("doc_id", path.alias("path")), "path")


def q_pages_to_document(spark, sf):
    c = table(spark, sf, "conversations")
    return RL.pages_to_document(c, "conv_id", "turn", "text").withColumnRenamed("text", "document")


def q_ordered_concat(spark, sf):
    c = table(spark, sf, "conversations")
    return RL.ordered_concat(c, ["conv_id"], "turn", "text", "\n", "transcript")


def q_metadata_map(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.explode(RL.json_metadata("props")).alias("key", "value"))


def q_error_as_value(spark, sf):
    d = table(spark, sf, "documents")
    d = d.withColumn("source_no", F.expr("try_cast(substring(source, 4) as int)"))
    out = RL.with_error(d, [(F.col("source").startswith("src") & F.col("source_no").isNotNull(), "Unparseable source"),
                            (F.col("n_chars") == F.length("text"), "n_chars mismatch")])
    return out.select("doc_id", "source_no", "error")


def q_merge_right_biased(spark, sf):
    e = table(spark, sf, "events")
    right = F.create_map(F.lit("k"), F.col("value").cast("string"), F.lit("type"), F.col("event_type"))
    m = RL.merge_maps(RL.json_metadata("props"), right)
    return e.select("event_id", F.explode(m).alias("key", "value"))


def q_analysis_sections(spark, sf):
    rep = page_report(table(spark, sf, "pages"))
    return RL.analysis_sections(rep, "page_id", ["title", "word_count", "summary"], ["headings", "paragraphs", "links"],
                                ["sentiment"])


def q_dedupe_keys(spark, sf):
    c = table(spark, sf, "conversations")
    return RL.last_per_key(c, ["conv_id"], "role", "text", "turn")


def q_feedback_format(spark, sf):
    f = feedback_rows(spark, sf)
    return f.select("feedback_id", feedback_format("question", "answer", "helpful").alias("line"))


def q_document_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("text").alias("type"), "text")
    rep = document_report(d)
    return rep.select("doc_id", "word_count", "summary", "polarity", "subjectivity", "positivity", "negativity",
                      "neutrality", "compound", F.array_join("top_terms", " ").alias("top_terms"))


def q_document_report_types(spark, sf):
    """T08 by envelope type: text, image text, dicom metadata, an unknown type."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % len(TYPES) + 1).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", kind.alias("type"), "text", F.create_map(
        F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    return document_report(d).select("doc_id", F.coalesce("word_count", F.lit(0)).cast("long").alias("word_count"), "summary", "compound", F.array_join("top_terms", " ").alias("top_terms"), "error")


TYPES = ["text", "image", "dicom", "video"]


def _line_count(pdf):
    out = pdf[["doc_id"]].copy()
    out["n_lines"] = pdf["text"].str.count("\n").astype("int64") + 1
    return out


def q_map_batches(spark, sf):
    return Y.map_batches(table(spark, sf, "documents").select("doc_id", "text"), _line_count,
                         "doc_id long, n_lines long")


def _brand_type(row):
    return f"{row['p_brand']}/{row['p_type']}"


def q_apply_rows(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", Y.apply_rows(["p_brand", "p_type"], _brand_type, "string").alias("label"))


def _head_model():
    def model(texts):
        return [(t[:50], 0.9) for t in texts]
    return model


def q_batch_infer(spark, sf):
    b = table(spark, sf, "benchmark")
    out = Y.batch_infer(b, "text", _head_model, "output")
    return out.select("item_id", "output", "confidence", "error")


QUERIES = {
    "route_by_suffix": q_route_by_suffix,
    "pages_to_document": q_pages_to_document,
    "ordered_concat": q_ordered_concat,
    "metadata_map": q_metadata_map,
    "error_as_value": q_error_as_value,
    "merge_right_biased": q_merge_right_biased,
    "analysis_sections": q_analysis_sections,
    "dedupe_keys": q_dedupe_keys,
    "feedback_format": q_feedback_format,
    "document_report": q_document_report,
    "document_report_types": q_document_report_types,
    "map_batches": q_map_batches,
    "apply_rows": q_apply_rows,
    "batch_infer": q_batch_infer,
}

_ROUTE_CASE_R = "CASE " + " ".join(f"WHEN ends_with(lower(path), {lit(s)}) THEN {lit(r)}" for s, r, _ in SUFFIX_READERS) + " END"
_ROUTE_CASE_T = "CASE " + " ".join(f"WHEN ends_with(lower(path), {lit(s)}) THEN {lit(t)}" for s, _, t in SUFFIX_READERS) + " END"
_EXT_LIST = "[" + ", ".join(lit(e) for e in EXTS) + "]"

_SECTIONS = f"""WITH {_PE}, {sentiment_ctes('pe', 'page_id', 'text')},
{summary_ctes('pe', 'page_id', 'text', 'least(floor(length(text) / 2), 100)')},
r AS (SELECT pe.*, {sql_wc('text')} AS word_count, s.*, summ.summary FROM pe JOIN senti s ON pe.page_id = s.id
  LEFT JOIN summ ON summ.doc_id = pe.page_id),
u AS (
  SELECT page_id, 'title' AS section, 0::BIGINT AS ordinal, title AS value FROM r
  UNION ALL SELECT page_id, 'word_count', 0, word_count::VARCHAR FROM r
  UNION ALL SELECT page_id, 'summary', 0, summary FROM r
  UNION ALL SELECT page_id, 'headings', generate_subscripts(headings, 1) - 1, unnest(headings) FROM r
  UNION ALL SELECT page_id, 'paragraphs', generate_subscripts(paragraphs, 1) - 1, unnest(paragraphs) FROM r
  UNION ALL SELECT page_id, 'links', generate_subscripts(links, 1) - 1, unnest(links) FROM r
  {" ".join(f"UNION ALL SELECT page_id, 'sentiment.{c}', 0, {c}::VARCHAR FROM r" for c in
            ("polarity", "subjectivity", "positivity", "negativity", "neutrality", "compound"))})
SELECT page_id, section, ordinal::BIGINT AS ordinal, value FROM u WHERE value IS NOT NULL AND value <> ''"""

_DOCREP = f"""WITH {_WF_CTES}, {_SENTI}, {_SUMMARY_CTES},
tt AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS top_terms FROM wf WHERE rank <= {defaults.WORDCLOUD_MAX_WORDS} GROUP BY doc_id)
SELECT documents.doc_id, {sql_wc('documents.text')} AS word_count, summ.summary, senti.polarity, senti.subjectivity,
  senti.positivity, senti.negativity, senti.neutrality, senti.compound, coalesce(tt.top_terms, '') AS top_terms
FROM documents JOIN senti ON documents.doc_id = senti.id LEFT JOIN summ ON documents.doc_id = summ.doc_id
LEFT JOIN tt ON documents.doc_id = tt.doc_id"""

_TYPED = f"""WITH src AS (SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'lang: ' || lang || chr(10) || 'source: ' || source ELSE text END AS text
  FROM documents WHERE doc_id % 4 <> 3), {wf_ctes(False, 'src')}, {sentiment_ctes('src', 'doc_id', 'text')}, {summary_ctes('src')},
tt AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS top_terms FROM wf WHERE rank <= {defaults.WORDCLOUD_MAX_WORDS} GROUP BY doc_id)
SELECT src.doc_id, {sql_wc('src.text')} AS word_count, summ.summary, senti.compound, coalesce(tt.top_terms, '') AS top_terms, NULL::VARCHAR AS error
FROM src JOIN senti ON src.doc_id = senti.id LEFT JOIN summ ON src.doc_id = summ.doc_id LEFT JOIN tt ON src.doc_id = tt.doc_id
UNION ALL SELECT doc_id, 0::BIGINT, NULL, NULL, NULL, 'Unable to analyze content.' FROM documents WHERE doc_id % 4 = 3"""

SQL = {
    "document_report_types": _TYPED,
    "route_by_suffix": f"""WITH p AS (SELECT doc_id, 'doc_' || doc_id::VARCHAR || {_EXT_LIST}[doc_id % {len(EXTS)} + 1] AS path FROM documents)
SELECT doc_id, path, {_ROUTE_CASE_R} AS reader, {_ROUTE_CASE_T} AS type,
  CASE WHEN {_ROUTE_CASE_R} IS NULL THEN {lit(UNSUPPORTED)} END AS error FROM p""",
    "pages_to_document": "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS document FROM conversations GROUP BY conv_id",
    "ordered_concat": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id",
    "metadata_map": "SELECT event_id, j.key AS key, j.value::VARCHAR AS value FROM events, json_each(props) AS j",
    "error_as_value": """SELECT doc_id, try_cast(substring(source, 4) AS INTEGER) AS source_no,
  CASE WHEN NOT (starts_with(source, 'src') AND try_cast(substring(source, 4) AS INTEGER) IS NOT NULL) THEN 'Unparseable source'
       WHEN NOT (n_chars = length(text)) THEN 'n_chars mismatch' END AS error FROM documents""",
    "merge_right_biased": """SELECT event_id, 'k' AS key, value::VARCHAR AS value FROM events
UNION ALL SELECT event_id, 'type', event_type FROM events""",
    "analysis_sections": _SECTIONS,
    "dedupe_keys": "SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role",
    "feedback_format": f"""WITH {FEEDBACK_SQL} SELECT feedback_id, 'Question: ' || question || ', Answer: ' || answer || ', Helpful: ' ||
  CASE WHEN helpful IS NULL THEN 'None' WHEN helpful THEN 'True' ELSE 'False' END AS line FROM fb""",
    "map_batches": "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents",
    "apply_rows": "SELECT p_partkey, p_brand || '/' || p_type AS label FROM part",
    "document_report": _DOCREP,
    "batch_infer": "SELECT item_id, substring(text, 1, 50) AS output, 0.9::DOUBLE AS confidence, NULL::VARCHAR AS error FROM benchmark",
}
