"""Profiles of many tables at once (T08/T09): one plan by (file, column).

Input is the long frame of cells of ``sources.tables``.  One aggregation gives
every column of every file its type, counts, moments and approximate quantile
brackets; the exact quartiles are picked from the counted values inside the
brackets, which are joined as a table: nothing grows on the driver with the
number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults
from ..functions.numeric import round_half_up
from ..functions.text import word_count
from ..session import scratch_path
from .profile import QUANTILES, _pick_ranks, quantile_accuracy

COLUMN = ["path", "column_name"]
#: Statistics of a column of a file, as in A04 and A05.
STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max", "n_unique", "top", "freq"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def profile_cells(cells: DataFrame, digits: int = 6, stored: bool = False) -> DataFrame:
    """One row per (path, column): position, data_type (int64, float64, object)
    and ``STATS``; statistics that do not apply are null.  A column is numeric
    if all its cells are; top ties go to the smallest value.  A column without
    any cell is not known here and has no row.  NaN cells count as numbers
    without a value.  The cells are read several times: unless they are
    ``stored`` as a table, they are written first."""
    cells = cells.select(*COLUMN, "position", "value")
    cells = cells if stored else _stored(cells, "cells")
    most = cells.groupBy(*COLUMN).count().agg(F.max("count")).first()[0] or 0
    accuracy = quantile_accuracy(most)
    margin, k = 3.0 / accuracy, len(QUANTILES)
    wanted = [max(0.0, p - margin) for p in QUANTILES] + [min(1.0, p + margin) for p in QUANTILES]
    as_long = F.expr("try_cast(value as bigint)")
    number = F.expr("try_cast(value as double)")
    x = F.when(~F.isnan(number), number)
    stats = _stored(cells.groupBy(*COLUMN).agg(
        F.min("position").alias("position"), F.count("*").alias("n"), F.count(x).alias("nx"),
        F.count(F.when(F.col("value").rlike(r"^[+-]?[0-9]+$"), as_long)).alias("longs"), F.count(number).alias("doubles"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile_approx(x, wanted, accuracy).alias("br")), "column-stats")
    numeric = F.col("doubles") == F.col("n")
    # ranks of the quartiles with their brackets: one row per (column, quartile)
    key = F.struct(*COLUMN).alias("column_name")
    r = lambda p: F.lit(p) * (F.col("nx") - 1)
    ranks = stats.where(numeric & (F.col("nx") > 0)).select(key, F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), r(p).alias("r"), F.floor(r(p)).alias("r_lo"), F.ceil(r(p)).alias("r_hi"),
                 F.col("br")[i].alias("lo"), F.col("br")[k + i].alias("hi")) for i, p in enumerate(QUANTILES)])))
    long = cells.select(key, x.alias("x")).where("x is not null")
    keys = ["column_name", "p", "r", "r_lo", "r_hi"]
    inside = (long.join(ranks, "column_name").where("x <= hi")
              .groupBy(*keys, F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("xk")).agg(F.count("*").alias("c")))
    picked = _stored(_pick_ranks(inside, keys), "ranks")
    found = F.coalesce((F.coalesce("below", F.lit(0)) <= F.col("r_lo")) & (F.col("total") > F.col("r_hi")), F.lit(False))
    missed = picked.where(~found).select(*keys)
    if missed.take(1):                           # outside the sketch's guarantee: over the whole column
        redo = long.join(missed, "column_name").groupBy(*keys, F.col("x").alias("xk")).agg(F.count("*").alias("c"))
        picked = picked.where(found).unionByName(_pick_ranks(redo, keys))
    value = F.col("x_lo") + (F.col("r") - F.col("r_lo")) * (F.col("x_hi") - F.col("x_lo"))
    quartiles = picked.groupBy("column_name").agg(*[F.max(F.when(F.col("p") == p, value)).alias(f"p{round(100 * p)}") for p in QUANTILES])
    quartiles = quartiles.select("column_name.*", "p25", "p50", "p75")
    texts = cells.join(stats.where(~numeric).select(*COLUMN), COLUMN, "left_semi")
    tops = (texts.groupBy(*COLUMN, "value").agg(F.count("*").alias("c")).groupBy(*COLUMN)
            .agg(F.count("*").alias("n_unique"), F.min(F.struct((-F.col("c")).alias("c"), "value"))["value"].alias("top"),
                 F.max("c").alias("freq")))
    out = stats.join(quartiles, COLUMN, "left").join(tops, COLUMN, "left")
    kind = F.when(F.col("longs") == F.col("n"), "int64").when(numeric, "float64").otherwise("object")
    moment = lambda c: round_half_up(F.when(numeric, F.col(c)), digits).alias(c)
    return out.select("path", "position", "column_name", kind.alias("data_type"),
                      F.when(numeric, F.col("nx")).otherwise(F.col("n")).alias("count"),
                      *[moment(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")], "n_unique", "top", "freq")


def table_texts(cells: DataFrame, max_chars: int = defaults.TEXT_BUDGET) -> DataFrame:
    """(path, word_count, text): the words of all cells of a table (A03), and the
    first ``max_chars`` characters of its row text (W03).  Each cell gives at
    least a character and a separator, so a bounded number of first cells holds
    them; they are trimmed in each task before the exchange."""
    words = cells.groupBy("path").agg(F.sum(word_count("value")).alias("word_count"))
    place = Window.partitionBy("path").orderBy("block", "row_no", "position")
    head = (cells.select("path", "block", "row_no", "position", F.substring("value", 1, max_chars).alias("value"))
            .withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= max_chars // 2 + 1)
            .groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("c"))
            .select("path", F.substring(F.array_join(F.transform("c", lambda s: s["value"]), " "), 1, max_chars).alias("text")))
    return words.join(head, "path", "left")
