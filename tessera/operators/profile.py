"""Table profiling.

All columns are profiled in one pass each: the table is unpivoted once into
a long ``(column, x)`` form (numeric) or ``(column, value)`` form
(categorical), so one aggregation job covers every column instead of one job
per column.  Per-column dictionaries (min/max, totals, quantile brackets) are
bounded by the number of columns and broadcast.

Exact quantiles without a single-task merge: an approximate pass
(``percentile_approx``, mergeable and bounded; it also yields the moments)
brackets each wanted rank, an exact count below the bracket fixes the
offset, and only the rows inside the bracket (about 6n/accuracy, sized to
~1M) are sorted per (column, quantile).  Per-column results (columns x
quantiles rows) are collected between passes.  Interpolation is linear, as
in pandas ``describe``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import defaults
from ..functions.numeric import round_half_up
from ..functions.text import percent_label, word_count

QUANTILES = (0.25, 0.5, 0.75)
BRACKET_ROWS = 1_000_000      # rows sorted per (column, quantile) in the exact pass
MIN_ACCURACY, MAX_ACCURACY = 10_000, 10_000_000


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns (booleans excluded, as in pandas)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Names of text columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*categorical_columns(df))


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Non-null cells as text joined by one space."""
    cols = columns or df.columns
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is neither null nor NaN."""
    c = F.col(column)
    dt = df.schema[column].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return df.where(c.isNotNull() & ~F.isnan(c))
    return df.where(c.isNotNull())


def long_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, x double) for every non-null, non-NaN numeric cell."""
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, x double")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols])
    out = df.select(F.inline(pairs))
    return out.where(F.col("x").isNotNull() & ~F.isnan("x"))


def long_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value string) for every non-null text cell."""
    cols = columns if columns is not None else categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def quantile_accuracy(n_rows: int, bracket_rows: int = BRACKET_ROWS) -> int:
    """Accuracy for the approximate pass so that each exact bracket holds
    about ``bracket_rows`` rows (2 x margin x n with margin = 3 / accuracy)."""
    return int(min(MAX_ACCURACY, max(MIN_ACCURACY, math.ceil(6.0 * n_rows / bracket_rows))))


def quantile_brackets(long: DataFrame, probs=QUANTILES, accuracy: int = MIN_ACCURACY,
                      extra: list | None = None) -> DataFrame:
    """One aggregate per column: count, approximate bracket values for every
    wanted rank, plus any ``extra`` aggregates (column_name, n, br, ...)."""
    margin = 3.0 / accuracy
    lows = [max(0.0, p - margin) for p in probs]
    highs = [min(1.0, p + margin) for p in probs]
    return long.groupBy("column_name").agg(
        F.count("*").alias("n"), F.percentile_approx("x", lows + highs, accuracy).alias("br"), *(extra or []))


def exact_quantiles(long: DataFrame, probs=QUANTILES, accuracy: int | None = None,
                    stats: list | None = None) -> DataFrame:
    """(column, p, q) with q the linearly interpolated quantile of x.

    Rank r = p * (n - 1); q = x[floor r] + (r - floor r) * (x[ceil r] - x[floor r]).

    Pass 1 (``stats``, collected rows of ``quantile_brackets``, bounded by the
    number of columns) gives the count and sketch brackets.  Pass 2 reads the
    data once and keeps only rows inside a bracket (plus one count of the rows
    below it); the picked values (columns x quantiles rows) are collected.  A
    bracket outside the sketch's guarantee is redone over its full range in a
    third pass, only when it happens."""
    spark = long.sparkSession
    if stats is None:
        if accuracy is None:
            accuracy = quantile_accuracy(long.count())
        stats = quantile_brackets(long, probs, accuracy).collect()
    k = len(probs)
    rows = []
    for st in stats:
        n, br = st["n"], st["br"]
        for i, p in enumerate(probs):
            r = float(p) * (n - 1)
            rows.append((st["column_name"], float(p), r, math.floor(r), math.ceil(r), br[i], br[k + i]))
    schema = "column_name string, p double, r double, r_lo long, r_hi long, lo double, hi double"
    brackets = spark.createDataFrame(rows, schema)
    keys = ["column_name", "p", "r", "r_lo", "r_hi"]
    # rows below the bracket collapse into a null key (their count), rows
    # inside group by value, rows above are dropped
    inside = (long.join(F.broadcast(brackets), "column_name").where(F.col("x") <= F.col("hi"))
              .groupBy(*keys, F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("xk"))
              .agg(F.count("*").alias("c")))
    picked = _pick_ranks(inside, keys).collect()
    out, failed = [], []
    for r in picked:
        if (r["below"] or 0) <= r["r_lo"] and (r["total"] or 0) > r["r_hi"]:
            out.append(r)
        else:
            failed.append((r["column_name"], r["p"], r["r"], r["r_lo"], r["r_hi"]))
    if failed:
        redo_b = spark.createDataFrame(failed, "column_name string, p double, r double, r_lo long, r_hi long")
        redo = (long.join(F.broadcast(redo_b), "column_name")
                .groupBy(*keys, F.col("x").alias("xk")).agg(F.count("*").alias("c")))
        out += _pick_ranks(redo, keys).collect()
    result = [(r["column_name"], r["p"], r["x_lo"] + (r["r"] - r["r_lo"]) * (r["x_hi"] - r["x_lo"])) for r in out]
    return spark.createDataFrame(result, "column_name string, p double, q double")


def _pick_ranks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, xk, c) - xk null for rows below the bracket - the values at
    0-based ranks r_lo and r_hi: the smallest xk whose running count exceeds it."""
    w = Window.partitionBy("column_name", "p").orderBy(F.asc_nulls_first("xk")).rowsBetween(
        Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("c").over(w))
    return run.groupBy(*keys).agg(
        F.sum(F.when(F.col("xk").isNull(), F.col("c"))).alias("below"),
        F.max("upto").alias("total"),
        F.min(F.when(F.col("xk").isNotNull() & (F.col("upto") > F.col("r_lo")), F.col("xk"))).alias("x_lo"),
        F.min(F.when(F.col("xk").isNotNull() & (F.col("upto") > F.col("r_hi")), F.col("xk"))).alias("x_hi"))


def describe_numeric(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) per numeric column."""
    long = long_numeric(df, columns)
    # one pass gives the moments and the quantile brackets (the row count of
    # the table bounds every column's count, so it sizes the accuracy)
    stats = quantile_brackets(long, QUANTILES, quantile_accuracy(df.count()), extra=[
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")])
    stats = stats.collect()  # one row per column
    spark = df.sparkSession
    found = [(r["column_name"], r["n"], r["mean"], r["std"], r["min"], r["max"]) for r in stats]
    names = columns if columns is not None else numeric_columns(df)
    base = spark.createDataFrame(                 # a column without values has count 0
        found + [(c, 0, None, None, None, None) for c in names if c not in {r[0] for r in found}],
        "column_name string, count long, mean double, std double, min double, max double")
    qs = exact_quantiles(long, stats=stats).groupBy("column_name").pivot("p", list(QUANTILES)).agg(F.first("q"))
    for p, name in zip(QUANTILES, ("p25", "p50", "p75")):
        qs = qs.withColumnRenamed(str(p), name)
    out = base.join(qs, "column_name", "left")
    r = (lambda c: round_half_up(F.col(c), digits)) if digits is not None else F.col
    return out.select("column_name", "count", r("mean").alias("mean"), r("std").alias("std"), r("min").alias("min"),
                      r("p25").alias("p25"), r("p50").alias("p50"), r("p75").alias("p75"), r("max").alias("max"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) for every categorical column in one job.

    A hot value is combined map-side (partial aggregation) before the shuffle."""
    return long_categorical(df, columns).groupBy("column_name", "value").agg(F.count("*").cast("long").alias("n"))


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, unique, top, freq); top ties go to the smallest
    value; a column without values has count and unique 0."""
    vc = value_counts(df, columns)
    found = vc.groupBy("column_name").agg(
        F.sum("n").cast("long").alias("count"),
        F.count("*").cast("long").alias("n_unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v")))["v"].alias("top"),
        F.max("n").cast("long").alias("freq"))
    names = columns if columns is not None else categorical_columns(df)
    return (df.sparkSession.createDataFrame([(c,) for c in names], "column_name string").join(found, "column_name", "left")
            .select("column_name", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), "top", "freq"))


def counted_columns(df: DataFrame) -> list[str]:
    """Columns that A06 describes by counts: text, booleans, dates, timestamps."""
    kinds = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [*categorical_columns(df), *[f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]]


def describe_all(df: DataFrame) -> DataFrame:
    """Union of A04 and A05 over all columns, nulls where a statistic does
    not apply."""
    cat = describe_categorical(df, counted_columns(df))
    # numeric rows carry no unique/freq; doubles keep the mixed table null-safe
    cat = cat.withColumn("n_unique", F.col("n_unique").cast("double")).withColumn("freq", F.col("freq").cast("double"))
    return describe_numeric(df).unionByName(cat, allowMissingColumns=True)


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count("*").cast("long").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = defaults.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins per numeric column, all bins present (empty -> 0).

    Edges are lo + i * (hi - lo) / bins, the last bin closed; a constant
    column uses lo - 0.5 .. lo + 0.5.  Returns (column, bin, lo, hi, n)."""
    long = long_numeric(df, columns)
    rng = long.groupBy("column_name").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    rng = rng.select("column_name",
                     F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("e0"),
                     F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("e1"))
    rng = rng.withColumn("step", (F.col("e1") - F.col("e0")) / bins)
    x, e0, step = F.col("x"), F.col("e0"), F.col("step")
    idx0 = F.least(F.greatest(F.floor((x - e0) * (F.lit(float(bins)) / (F.col("e1") - e0))), F.lit(0)), F.lit(bins - 1))
    edge = lambda i: e0 + i * step
    binned = long.join(F.broadcast(rng), "column_name").withColumn("i0", idx0)
    i1 = F.when(x < edge(F.col("i0")), F.col("i0") - 1).otherwise(F.col("i0"))
    binned = binned.withColumn("i1", i1)
    i2 = F.when((x >= edge(F.col("i1") + 1)) & (F.col("i1") != bins - 1), F.col("i1") + 1).otherwise(F.col("i1"))
    counts = binned.withColumn("bin", i2.cast("long")).groupBy("column_name", "bin").agg(F.count("*").cast("long").alias("n"))
    all_bins = rng.select("column_name", "e0", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    all_bins = all_bins.withColumn("bin", F.col("bin").cast("long"))
    out = all_bins.join(counts, ["column_name", "bin"], "left")
    return out.select("column_name", "bin",
                      round_half_up(edge(F.col("bin")), 6).alias("lo"),
                      round_half_up(edge(F.col("bin") + 1), 6).alias("hi"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def share_of_total(counts: DataFrame, group: str = "column_name", n: str = "n") -> DataFrame:
    """100 * n / total of its group, via a join with the groups' totals
    rather than a window, so a large group never lands in one task."""
    totals = counts.groupBy(group).agg(F.sum(n).alias("_total"))
    return counts.join(totals, group).withColumn(
        "percent", round_half_up(F.lit(100.0) * F.col(n) / F.col("_total"), 6)).drop("_total")


def pie_percent(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A10: (column, value, n, percent, label) with label formatted '%.1f%%'."""
    return share_of_total(value_counts(df, columns)).withColumn("label", percent_label("percent"))


def bar_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Value counts in plotting order (count desc, value), a distributed sort."""
    return value_counts(df, columns).orderBy("column_name", F.desc("n"), "value")


def top_value(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, top, freq)."""
    return describe_categorical(df, columns).select("column_name", "top", "freq")


PANDAS_DTYPE = [
    (T.BooleanType, "bool"), (T.ByteType, "int8"), (T.ShortType, "int16"), (T.IntegerType, "int32"),
    (T.LongType, "int64"), (T.FloatType, "float32"), (T.DoubleType, "float64"), (T.DecimalType, "object"),
    (T.TimestampType, "datetime64[ns]"), (T.TimestampNTZType, "datetime64[ns]"), (T.StringType, "object"),
]


def pandas_dtype(dt: T.DataType) -> str:
    for cls, name in PANDAS_DTYPE:
        if isinstance(dt, cls):
            return name
    return "object"


def sample_examples(df: DataFrame, k: int = defaults.SAMPLE_EXAMPLES, seed: int = 42,
                    columns: list[str] | None = None) -> DataFrame:
    """Up to ``k`` non-null example values per column, chosen by a seeded
    hash (deterministic; fewer when fewer exist).  Each column is a global
    top-k of its own (TakeOrderedAndProject over the one column that it reads):
    a task keeps ``k`` rows and sorts nothing else."""
    cols = columns or df.columns
    found = df.sparkSession.createDataFrame([], "column_name string, value string, _h string") if not cols else None
    for c in cols:
        value = F.col(c).cast("string")
        one = (df.select(F.lit(c).alias("column_name"), value.alias("value")).where("value is not null")
               .withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("column_name"), F.lit(":"), F.col("value"))))
               .orderBy("_h", "value").limit(k))
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("column_name").orderBy("_h", "value")
    return found.select("column_name", F.row_number().over(w).cast("long").alias("ordinal"), "value")


def column_summary(df: DataFrame, k: int = defaults.SAMPLE_EXAMPLES, seed: int = 42) -> DataFrame:
    """(column, data_type, ordinal, example); a column without values has
    one row with nulls."""
    types = df.sparkSession.createDataFrame([(f.name, pandas_dtype(f.dataType)) for f in df.schema.fields],
                                            "column_name string, data_type string")
    return (types.join(sample_examples(df, k, seed), "column_name", "left")
            .select("column_name", "data_type", "ordinal", F.col("value").alias("example")))


def preview(df: DataFrame, order_by: list[str], n: int = defaults.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows by an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def table_word_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Words of the row-joined text, summed per row (rows are joined by a
    space, so the count is additive and no global string is built)."""
    return df.select(word_count(row_text(df, columns)).alias("wc")).agg(
        F.coalesce(F.sum("wc"), F.lit(0)).cast("long").alias("word_count"))


def truncate_table_text(df: DataFrame, order_by: list[str], max_chars: int = defaults.TEXT_BUDGET) -> DataFrame:
    """First ``max_chars`` characters of the row-joined table text.

    Each row contributes at least its separator, so the first max_chars + 1
    rows always hold enough text: a bounded top-k, then an ordered concat."""
    head = df.select(*order_by, row_text(df).alias("_t")).orderBy(*order_by).limit(max_chars + 1)
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_by], F.col("_t"))))
    return head.agg(F.substring(F.array_join(F.transform(ordered, lambda s: s["_t"]), " "), 1, max_chars).alias("text"))


def _fmt(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def profile_summary(df: DataFrame) -> DataFrame:
    """One sentence per column of the A06 table, in column order."""
    order = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column_name string, idx int")
    d = describe_all(df).join(F.broadcast(order), "column_name")
    sent = F.concat(F.col("column_name"), F.lit(": count "), _fmt("count"), F.lit(", mean "), _fmt("mean"),
                    F.lit(", std "), _fmt("std"), F.lit(", min "), _fmt("min"), F.lit(", median "), _fmt("p50"),
                    F.lit(", max "), _fmt("max"), F.lit(", unique "), _fmt("n_unique"), F.lit(", top "), _fmt("top"),
                    F.lit(", freq "), _fmt("freq"), F.lit("."))
    ordered = F.array_sort(F.collect_list(F.struct("idx", sent.alias("s"))))
    return d.agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("summary"))


def table_report(df: DataFrame) -> DataFrame:
    """The whole profile as one long (column, stat, value) table: shape,
    types, A04/A05 statistics, histogram bins, value counts with their shares,
    examples and the summary."""
    d = describe_all(df)
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max", "n_unique", "top", "freq"]
    long = d.select("column_name", F.inline(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).cast("string").alias("value")) for s in stats])))
    long = long.where(F.col("value").isNotNull())
    spark = df.sparkSession
    types = spark.createDataFrame([(f.name, "data_type", pandas_dtype(f.dataType)) for f in df.schema.fields],
                                  "column_name string, stat string, value string")
    sh = shape(df).select(F.inline(F.array(
        F.struct(F.lit("*").alias("column_name"), F.lit("rows").alias("stat"), F.col("rows").cast("string").alias("value")),
        F.struct(F.lit("*").alias("column_name"), F.lit("columns").alias("stat"),
                 F.col("columns").cast("string").alias("value")))))
    stat = lambda name, key, value: (F.concat(F.lit(f"{name}:"), key.cast("string")).alias("stat"), value.cast("string").alias("value"))
    bins = histogram(df).select("column_name", *stat("histogram", F.col("bin"), F.col("n")))
    shares = pie_percent(df).select("column_name", F.inline(F.array(
        F.struct(*stat("bar", F.col("value"), F.col("n"))), F.struct(*stat("pie", F.col("value"), F.col("label"))))))
    examples = sample_examples(df).select("column_name", *stat("example", F.col("ordinal"), F.col("value")))
    summary = profile_summary(df).select(F.lit("*").alias("column_name"), F.lit("summary").alias("stat"), F.col("summary").alias("value"))
    out = long
    for part in (types, sh, bins, shares, examples, summary):
        out = out.unionByName(part)
    return out
