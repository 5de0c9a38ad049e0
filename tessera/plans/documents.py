"""Document report (T08): dispatch by envelope type, one text plan for all.

Envelopes are rows ``(doc_id, type, text, metadata)``: text-like types
(text, image text, pdf/docx text) are scored as they are; dicom rows are
scored on their metadata rendered as 'key: value' lines (F10).  Tables
are profiled by ``table_report`` and their row text is reported here too,
kept in a separate column instead of being overwritten (Q1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import defaults
from ..functions.terms import summary, top_terms
from ..functions.text import metadata_text, word_count
from ..operators.fileprofile import STATS, profile_cells, table_texts
from ..operators.profile import row_text, table_report, table_word_count, truncate_table_text
from ..operators.sentiment import with_sentiment
from ..session import text_batches
from ..sources.files import raw_files, read_documents
from ..sources.tables import _stored, table_cells


def text_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lexicon: DataFrame | None = None, k: int = defaults.WORDCLOUD_MAX_WORDS) -> DataFrame:
    """Text body of T08 on the whole text: (id, word_count, summary, sentiment
    fields, top_terms array), one row per row of ``df``, whatever its id.
    Sentiment, summary and terms are worked out in the row."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"), word_count(text_col).alias("word_count"))
    return with_terms(with_sentiment(rows, "text", None, lexicon), k).drop("text")


def with_terms(rows: DataFrame, k: int = defaults.WORDCLOUD_MAX_WORDS, budget: int | str = defaults.SUMMARY_TOKEN_BUDGET) -> DataFrame:
    """``rows`` (text, ...) with summary and top_terms of their texts, worked out
    where the text is."""
    text_batches(rows.sparkSession)
    found = summary(F.col("text"), F.col(budget) if isinstance(budget, str) else F.lit(budget))
    return (rows.withColumns({"_found": found, "top_terms": top_terms(F.col("text"), k)})
            .withColumn("summary", F.col("_found.summary")).drop("_found"))


def envelope_text(type_col: str = "type", text_col: str = "text", metadata_col: str = "metadata"):
    """The text a report is built from, per envelope type."""
    return F.when(F.col(type_col) == "dicom", metadata_text(F.col(metadata_col))).otherwise(F.col(text_col))


#: Types with a text report; tables have ``table_document_report``.
REPORTED = ("text", "image", "dicom", "dataframe")
NOT_ANALYZED = "Unable to analyze content."


def document_report(envelopes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """T08 over envelopes: text, image text, dicom metadata and the row text of
    tables are reported.  Rows with an ``error`` keep it and have no report;
    other types have the error ``NOT_ANALYZED``."""
    cols = envelopes.columns
    known = F.coalesce(F.col("type").isin(*REPORTED), F.lit(False))
    own = F.col("error") if "error" in cols else F.lit(None).cast("string")
    rows = envelopes.withColumn("_error", F.coalesce(own, F.when(~known, F.lit(NOT_ANALYZED))))
    text = envelope_text("type", "text", "metadata") if "metadata" in cols else F.col("text")
    rep = text_report(rows.where("_error is null").select(id_col, text.alias("_t")), id_col, "_t")
    errs = rows.where("_error is not null").select(id_col, F.col("_error").alias("error"))
    return rep.unionByName(errs, allowMissingColumns=True)


def table_document_report(df: DataFrame, order_by: list[str]) -> dict[str, DataFrame]:
    """T08 for a table: the profile (T09) and the text report of its row
    text, as separate outputs (Q1: nothing is overwritten)."""
    head = truncate_table_text(df, order_by).withColumn("doc_id", F.lit(0))
    return {
        "profile": table_report(df),
        "word_count": table_word_count(df),
        "text": text_report(head, "doc_id", "text").drop("word_count"),
        "row_text": df.select(*order_by, row_text(df).alias("row_text")),
    }


def folder_report(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """T08 and T09 over a mixed folder or a pack of files, one row per file: (path, type, the text
    report, profile, error).  ``profile`` holds a struct for each column of a
    table with its type and statistics, in column order, and is null for other
    types; a table's words are those of all its cells, the rest of its text
    report is that of the first ``TEXT_BUDGET`` characters of its row text.  A
    table without cells has an empty profile; files that cannot be read have
    their error."""
    if isinstance(path, DataFrame):
        envelopes = read_documents(spark, path).withColumn("_file", F.col("path"))
    else:
        names = raw_files(spark, path).select("path", F.col("_metadata.file_path").alias("_file"))
        envelopes = read_documents(spark, path).join(names, "path")
    cells = _stored(table_cells(spark, path), "folder-cells")      # parsed once, for profiles, words and texts
    columns = F.struct("position", F.col("column_name").alias("name"), "data_type", *STATS)
    profiles = profile_cells(cells, stored=True).groupBy("path").agg(F.array_sort(F.collect_list(columns)).alias("profile"))
    known = (envelopes.join(profiles.withColumnRenamed("path", "_file"), "_file", "left")
             .join(table_texts(cells).select(F.col("path").alias("_file"), F.col("text").alias("_text"), F.col("word_count").alias("_words")), "_file", "left"))
    is_table = F.col("type") == "dataframe"
    known = known.select("path", "type", "error", F.when(is_table, F.coalesce("_text", F.lit(""))).otherwise(F.col("text")).alias("text"),
                         F.when(is_table, F.coalesce("_words", F.lit(0))).alias("_words"),
                         F.when(is_table, F.coalesce("profile", F.array().cast(profiles.schema["profile"].dataType))).alias("profile"))
    report = document_report(known.select("path", "type", "text", "error"), "path").drop("error")
    return (known.drop("text").join(report, "path", "left")
            .withColumn("word_count", F.coalesce("_words", "word_count")).drop("_words"))
