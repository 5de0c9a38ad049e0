"""Profile queries: P01-P04, A03-A13, W02-W04, L01-L02, T04, T09."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import defaults
from ..operators import profile as P
from .common import round6, table, word_count as sql_wc


def q_select_numeric(spark, sf):
    return P.select_numeric(table(spark, sf, "part"))


def q_select_categorical(spark, sf):
    return P.select_categorical(table(spark, sf, "part"))


def q_row_to_text(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", P.row_text(p).alias("row_text"))


def _customer_with_missing(spark, sf):
    c = table(spark, sf, "customer")
    return c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")))


def q_drop_missing(spark, sf):
    return P.drop_missing(_customer_with_missing(spark, sf), "c_acctbal").select("c_custkey", "c_acctbal")


def q_describe_numeric(spark, sf):
    return P.describe_numeric(table(spark, sf, "lineitem"))


def q_describe_categorical(spark, sf):
    return P.describe_categorical(table(spark, sf, "part"))


def q_describe_all(spark, sf):
    return P.describe_all(table(spark, sf, "part"))


def q_shape(spark, sf):
    return P.shape(table(spark, sf, "lineitem"))


def q_value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "customer"))


def q_histogram(spark, sf):
    return P.histogram(table(spark, sf, "events"))


def q_pie_percent(spark, sf):
    return P.pie_percent(table(spark, sf, "part"))


def q_bar_counts(spark, sf):
    return P.bar_counts(table(spark, sf, "orders"))


def q_top_value(spark, sf):
    return P.top_value(table(spark, sf, "lineitem"))


def q_column_summary(spark, sf):
    return P.column_summary(table(spark, sf, "part"))


def q_sample_three(spark, sf):
    return P.sample_examples(_customer_with_missing(spark, sf))


def q_preview(spark, sf):
    return P.preview(table(spark, sf, "part"), ["p_partkey"])


def q_table_word_count(spark, sf):
    return P.table_word_count(table(spark, sf, "part"))


def q_truncate_table_text(spark, sf):
    return P.truncate_table_text(table(spark, sf, "part"), ["p_partkey"])


def q_profile_summary(spark, sf):
    return P.profile_summary(table(spark, sf, "part"))


def q_table_report(spark, sf):
    return P.table_report(table(spark, sf, "part"))


def q_share_of_total(spark, sf):
    e = table(spark, sf, "events")
    counts = e.groupBy(F.lit("event_type").alias("column_name"), F.col("event_type").alias("value")).agg(
        F.count("*").cast("long").alias("n"))
    return P.share_of_total(counts)


def q_percent_label(spark, sf):
    from ..functions.text import percent_label
    return q_share_of_total(spark, sf).select("value", percent_label("percent").alias("label"))


QUERIES = {
    "percent_label": q_percent_label,
    "select_numeric": q_select_numeric,
    "select_categorical": q_select_categorical,
    "row_to_text": q_row_to_text,
    "drop_missing": q_drop_missing,
    "describe_numeric": q_describe_numeric,
    "describe_categorical": q_describe_categorical,
    "describe_all": q_describe_all,
    "shape": q_shape,
    "value_counts": q_value_counts,
    "histogram": q_histogram,
    "pie_percent": q_pie_percent,
    "bar_counts": q_bar_counts,
    "top_value": q_top_value,
    "column_summary": q_column_summary,
    "sample_three": q_sample_three,
    "preview": q_preview,
    "table_word_count": q_table_word_count,
    "truncate_table_text": q_truncate_table_text,
    "profile_summary": q_profile_summary,
    "table_report": q_table_report,
    "share_of_total": q_share_of_total,
}

PART_NUM = ["p_partkey", "p_size", "p_retailprice"]
PART_CAT = ["p_name", "p_brand", "p_type"]
LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]


def long_num(tbl, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::DOUBLE AS x FROM {tbl}" for c in cols)


def long_cat(tbl, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value FROM {tbl}" for c in cols)


def describe_num_sql(tbl, cols):
    return f"""SELECT column_name, count(x)::BIGINT AS count, {round6('avg(x)')} AS mean, {round6('stddev_samp(x)')} AS std,
  {round6('min(x)')} AS min, {round6('quantile_cont(x, 0.25)')} AS p25, {round6('quantile_cont(x, 0.5)')} AS p50,
  {round6('quantile_cont(x, 0.75)')} AS p75, {round6('max(x)')} AS max
FROM ({long_num(tbl, cols)}) WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY column_name"""


def describe_cat_sql(tbl, cols):
    return f"""SELECT column_name, sum(n)::BIGINT AS count, count(*)::BIGINT AS n_unique,
  arg_min(value, (-n, value)) AS top, max(n)::BIGINT AS freq
FROM (SELECT column_name, value, count(*) AS n FROM ({long_cat(tbl, cols)}) WHERE value IS NOT NULL GROUP BY 1, 2)
GROUP BY column_name"""


def describe_all_sql(tbl, num, cat):
    return f"""SELECT column_name, count, mean, std, min, p25, p50, p75, max, NULL::DOUBLE AS n_unique, NULL::VARCHAR AS top,
  NULL::DOUBLE AS freq FROM ({describe_num_sql(tbl, num)})
UNION ALL SELECT column_name, count, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n_unique::DOUBLE, top, freq::DOUBLE FROM ({describe_cat_sql(tbl, cat)})"""


def fmt(c):
    return f"coalesce({c}::VARCHAR, '-')"


_PART_ORDER = "(VALUES ('p_partkey', 0), ('p_name', 1), ('p_brand', 2), ('p_type', 3), ('p_size', 4), ('p_retailprice', 5)) AS o(column_name, idx)"


def histogram_sql(tbl, cols):
    return f"""WITH l AS ({long_num(tbl, cols)}),
r0 AS (SELECT column_name, min(x) AS a, max(x) AS b FROM l WHERE x IS NOT NULL GROUP BY 1),
r AS (SELECT column_name, CASE WHEN a = b THEN a - 0.5 ELSE a END AS e0, CASE WHEN a = b THEN b + 0.5 ELSE b END AS e1 FROM r0),
r2 AS (SELECT *, (e1 - e0) / 10 AS step FROM r),
b0 AS (SELECT l.column_name, x, e0, step, least(greatest(floor((x - e0) * (10.0 / (e1 - e0))), 0), 9) AS i0 FROM l JOIN r2 USING (column_name) WHERE x IS NOT NULL),
b1 AS (SELECT *, CASE WHEN x < e0 + i0 * step THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT column_name, CASE WHEN x >= e0 + (i1 + 1) * step AND i1 <> 9 THEN i1 + 1 ELSE i1 END AS bin FROM b1),
c AS (SELECT column_name, bin::BIGINT AS bin, count(*) AS n FROM b2 GROUP BY 1, 2),
ab AS (SELECT column_name, e0, step, unnest(range(0, 10))::BIGINT AS bin FROM r2)
SELECT ab.column_name, ab.bin, {round6('e0 + ab.bin * step')} AS lo, {round6('e0 + (ab.bin + 1) * step')} AS hi,
  coalesce(n, 0)::BIGINT AS n FROM ab LEFT JOIN c ON ab.column_name = c.column_name AND ab.bin = c.bin"""


PIE = f"""WITH vc AS (SELECT column_name, value, count(*) AS n FROM ({long_cat('part', PART_CAT)}) WHERE value IS NOT NULL GROUP BY 1, 2),
pc AS (SELECT column_name, value, n::BIGINT AS n, {round6('100.0 * n / sum(n) OVER (PARTITION BY column_name)')} AS percent FROM vc)
SELECT *, ((floor(percent * 10.0 + 0.5) / 10.0)::DOUBLE)::VARCHAR || '%' AS label FROM pc"""
SUMMARY = f"""WITH d AS ({describe_all_sql('part', PART_NUM, PART_CAT)})
SELECT string_agg(column_name || ': count ' || {fmt('count')} || ', mean ' || {fmt('mean')} || ', std ' || {fmt('std')}
  || ', min ' || {fmt('min')} || ', median ' || {fmt('p50')} || ', max ' || {fmt('max')} || ', unique ' || {fmt("n_unique")}
  || ', top ' || {fmt('top')} || ', freq ' || {fmt('freq')} || '.', ' ' ORDER BY idx) AS summary
FROM d JOIN {_PART_ORDER} USING (column_name)"""

SQL = {
    "percent_label": f"""SELECT event_type AS value, ((floor({round6('100.0 * count(*) / sum(count(*)) OVER ()')} * 10.0 + 0.5) / 10.0)::DOUBLE)::VARCHAR || '%' AS label
  FROM events GROUP BY event_type""",
    "select_numeric": "SELECT p_partkey, p_size, p_retailprice FROM part",
    "select_categorical": "SELECT p_name, p_brand, p_type FROM part",
    "row_to_text": "SELECT p_partkey, concat_ws(' ', p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR) AS row_text FROM part",
    "drop_missing": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 AND c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)",
    "describe_numeric": describe_num_sql("lineitem", LINE_NUM),
    "describe_categorical": describe_cat_sql("part", PART_CAT),
    "describe_all": describe_all_sql("part", PART_NUM, PART_CAT),
    "shape": "SELECT count(*)::BIGINT AS rows, 11::BIGINT AS columns FROM lineitem",
    "value_counts": f"SELECT column_name, value, count(*)::BIGINT AS n FROM ({long_cat('customer', ['c_name', 'c_mktsegment'])}) WHERE value IS NOT NULL GROUP BY 1, 2",
    "histogram": histogram_sql('events', ['event_id', 'user_id', 'value']),
    "pie_percent": PIE,
    "bar_counts": f"SELECT column_name, value, count(*)::BIGINT AS n FROM ({long_cat('orders', ['o_orderstatus', 'o_orderpriority'])}) WHERE value IS NOT NULL GROUP BY 1, 2",
    "top_value": f"SELECT column_name, top, freq FROM ({describe_cat_sql('lineitem', ['l_returnflag', 'l_linestatus'])})",
    "column_summary": f"""WITH l AS ({long_cat('part', ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'])}),
r AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY md5('42:' || column_name || ':' || value), value) AS ordinal
  FROM l WHERE value IS NOT NULL)
SELECT r.column_name, t.data_type, ordinal::BIGINT AS ordinal, value AS example FROM r JOIN (VALUES ('p_partkey', 'int64'),
  ('p_name', 'object'), ('p_brand', 'object'), ('p_type', 'object'), ('p_size', 'int32'), ('p_retailprice', 'float64')) AS t(column_name, data_type)
  ON r.column_name = t.column_name WHERE ordinal <= 3""",
    "sample_three": f"""WITH c AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer),
l AS ({long_cat('c', ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'])}),
r AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY md5('42:' || column_name || ':' || value), value) AS ordinal
  FROM l WHERE value IS NOT NULL)
SELECT column_name, ordinal::BIGINT AS ordinal, value FROM r WHERE ordinal <= 3""",
    "preview": "SELECT * FROM part ORDER BY p_partkey LIMIT 5",
    "table_word_count": f"""SELECT coalesce(sum({sql_wc("concat_ws(' ', p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR)")}), 0)::BIGINT AS word_count FROM part""",
    "truncate_table_text": f"""SELECT substring(string_agg(t, ' ' ORDER BY p_partkey), 1, {defaults.TEXT_BUDGET}) AS text FROM (
  SELECT p_partkey, concat_ws(' ', p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR) AS t
  FROM part ORDER BY p_partkey LIMIT {defaults.TEXT_BUDGET + 1})""",
    "profile_summary": SUMMARY,
    "table_report": f"""WITH d AS ({describe_all_sql('part', PART_NUM, PART_CAT)}),
l AS (SELECT column_name, unnest(['count', 'mean', 'std', 'min', 'p25', 'p50', 'p75', 'max', 'n_unique', 'top', 'freq']) AS stat,
  unnest([count::VARCHAR, mean::VARCHAR, std::VARCHAR, min::VARCHAR, p25::VARCHAR, p50::VARCHAR, p75::VARCHAR, max::VARCHAR,
          n_unique::VARCHAR, top, freq::VARCHAR]) AS value FROM d)
SELECT * FROM l WHERE value IS NOT NULL
UNION ALL SELECT * FROM (VALUES ('p_partkey', 'data_type', 'int64'), ('p_name', 'data_type', 'object'), ('p_brand', 'data_type', 'object'),
  ('p_type', 'data_type', 'object'), ('p_size', 'data_type', 'int32'), ('p_retailprice', 'data_type', 'float64')) AS t(column_name, stat, value)
UNION ALL SELECT '*', 'rows', count(*)::VARCHAR FROM part
UNION ALL SELECT '*', 'columns', '6'
UNION ALL SELECT column_name, 'histogram:' || bin::VARCHAR, n::VARCHAR FROM ({histogram_sql('part', PART_NUM)})
UNION ALL SELECT column_name, 'bar:' || value, n::VARCHAR FROM ({PIE})
UNION ALL SELECT column_name, 'pie:' || value, label FROM ({PIE})
UNION ALL SELECT column_name, 'example:' || ordinal::VARCHAR, value FROM (SELECT column_name, value,
  row_number() OVER (PARTITION BY column_name ORDER BY md5('42:' || column_name || ':' || value), value) AS ordinal
  FROM ({long_cat('part', ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'])}) WHERE value IS NOT NULL) WHERE ordinal <= 3
UNION ALL SELECT '*', 'summary', summary FROM ({SUMMARY})""",
    "share_of_total": f"""SELECT 'event_type' AS column_name, event_type AS value, count(*)::BIGINT AS n,
  {round6('100.0 * count(*) / sum(count(*)) OVER ()')} AS percent FROM events GROUP BY event_type""",
}
