"""Small relational operators: P06, P07, P10, U03, A15, S08, S09."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c, ColumnOrName

PIXEL_GROUP = 0x7FE0  # tag group holding pixel data, excluded from metadata


def with_error(df: DataFrame, checks: list[tuple[Column, str]], error_col: str = "error") -> DataFrame:
    """Failures become a value: ``error`` holds the message of the first
    failing check (null when every check passes).  Split with
    ``where(error is null)`` / ``where(error is not null)``."""
    err = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        err = F.when(~F.coalesce(cond, F.lit(False)), F.lit(msg)).otherwise(err)
    return df.withColumn(error_col, err)


def empty_table_error(df: DataFrame, message: str = "DataFrame is empty.") -> DataFrame:
    """One row (rows, error) with the message when the table has no rows."""
    return df.agg(F.count("*").cast("long").alias("rows")).withColumn(
        "error", F.when(F.col("rows") == 0, F.lit(message)))


def merge_maps(left: ColumnOrName, right: ColumnOrName) -> Column:
    """``{**left, **right}`` - keys of the right map win, no session
    setting needed (left entries whose key is in right are dropped first)."""
    r = _c(right)
    return F.map_concat(F.map_filter(_c(left), lambda k, v: ~F.array_contains(F.map_keys(r), k)), r)


def last_per_key(df: DataFrame, group: list[str], key: str, value: str, order: str) -> DataFrame:
    """Dictionary semantics - one value per (group, key), the last by
    ``order`` wins (``max_by`` aggregate, partially aggregated)."""
    return df.groupBy(*group, key).agg(F.max_by(value, order).alias(value))


def ordered_concat(df: DataFrame, group: list[str], pos: str, text: str, sep: str,
                   out: str = "text") -> DataFrame:
    """Texts of a group joined by ``sep`` in ``pos`` order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(out))


def pages_to_document(pages: DataFrame, doc: str = "doc_id", page_no: str = "page_no",
                      text: str = "text") -> DataFrame:
    """Extracted page texts -> one document text, pages joined with no separator."""
    return ordered_concat(pages, [doc], page_no, text, "", "text")


def metadata_map(tags: DataFrame, doc: str, group_col: str, name_col: str, value_col: str,
                 exclude_group: int = PIXEL_GROUP, order_col: str | None = None) -> DataFrame:
    """Tag table -> (doc, metadata map<string,string>), one group
    excluded; of a repeated name the last value by ``order_col`` wins (the
    largest value without one), rows without a name are left out."""
    kept = tags.where((F.col(group_col) != exclude_group) & F.col(name_col).isNotNull())
    value = F.col(value_col).cast("string")
    order = F.struct(F.col(order_col), value) if order_col else F.struct(value)
    last = kept.groupBy(doc, F.col(name_col).alias("key")).agg(F.max_by(F.struct(value.alias("value")), order).alias("_v"))
    return last.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("key", F.col("_v.value").alias("value"))))).alias("metadata"))


def json_metadata(props: ColumnOrName) -> Column:
    """S09 for JSON property strings: map<string,string> (null when invalid)."""
    return F.from_json(_c(props), "map<string,string>")


def analysis_sections(report: DataFrame, id_col: str, scalars: list[str], arrays: list[str],
                      structs: list[str] = ()) -> DataFrame:
    """P10: a report row -> displayed sections (id, section, ordinal, value),
    each only when present and non-empty; arrays give one item per element,
    struct fields become 'struct.field' sections."""
    item = lambda name, at, value: F.struct(
        F.lit(name).alias("section"), at.cast("long").alias("ordinal"), value.cast("string").alias("value"))
    singles = [item(s, F.lit(0), F.col(s)) for s in scalars]
    for st in structs:
        singles += [item(f"{st}.{f.name}", F.lit(0), F.col(f"{st}.{f.name}")) for f in report.schema[st].dataType.fields]

    def items_of(name: str) -> Column:
        none = F.array().cast("array<struct<section: string, ordinal: bigint, value: string>>")
        return F.coalesce(F.transform(name, lambda v, i: item(name, i, v)), none)

    lists = [items_of(a) for a in arrays]
    # one array of all sections, so that the report is computed once
    out = report.select(id_col, F.inline(F.concat(F.array(*singles), *lists) if singles else F.concat(*lists)))
    return out.where(F.col("value").isNotNull() & (F.col("value") != ""))
