"""Card C3 (histogram) and the profile operators against pandas / numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import profile as P


def test_histogram_edges_constant_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (10.0, None), (3.5, 5.0)],
                               "x double, c double")
    h = {(r["column_name"], r["bin"]): r for r in P.histogram(df).collect()}
    xs = [1.0, 2.0, 10.0, 3.5]
    counts, edges = np.histogram(xs, bins=10)
    assert [h[("x", i)]["n"] for i in range(10)] == counts.tolist()        # max lands in the last bin
    assert h[("x", 9)]["hi"] == pytest.approx(edges[-1])
    cc, ce = np.histogram([5.0] * 4, bins=10)                                # constant column
    assert [h[("c", i)]["n"] for i in range(10)] == cc.tolist()
    assert h[("c", 0)]["lo"] == pytest.approx(ce[0])
    assert sum(h[("x", i)]["n"] for i in range(10)) == 4                     # bins sum to non-null count


def test_histogram_matches_numpy_on_events(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    got = [r["n"] for r in P.histogram(e, ["value"]).orderBy("bin").collect()]
    values = e.select("value").toPandas()["value"].to_numpy()
    assert got == np.histogram(values, bins=10)[0].tolist()
    assert got[8] == 0                                                       # empty 9th bin kept


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, np.nan, 10.0], "b": [5, 3, 9, 1, 2, 8],
                        "s": ["x", "y", "x", None, "z", "x"]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b long, s string")
    got = {r["column_name"]: r for r in P.describe_numeric(df).collect()}
    want = pdf[["a", "b"]].describe()
    for c in ("a", "b"):
        for stat, name in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                           ("25%", "p25"), ("50%", "p50"), ("75%", "p75"), ("max", "max")):
            assert got[c][name] == pytest.approx(want.loc[stat, c], abs=1e-6), (c, stat)
    cat = P.describe_categorical(df).first()
    assert (cat["count"], cat["n_unique"], cat["top"], cat["freq"]) == (5, 3, "x", 3)


def test_exact_quantiles_bracket_and_fallback(spark):
    rng = np.random.default_rng(7)
    xs = rng.normal(size=5000).round(3)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    long = P.long_numeric(df)
    for acc in (10, 100_000):      # a coarse sketch (fallback path) and a fine one (bracket path)
        q = {r["p"]: r["q"] for r in P.exact_quantiles(long, accuracy=acc).collect()}
        for p in P.QUANTILES:
            assert q[p] == pytest.approx(float(np.quantile(xs, p)), abs=1e-9)


def test_value_counts_percent_examples(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), ("a", 5)], "s string, k long")
    pie = {r["value"]: r for r in P.pie_percent(df, ["s"]).collect()}
    assert pie["a"]["n"] == 3 and pie["a"]["label"] == "75.0%" and pie["b"]["label"] == "25.0%"
    assert sum(r["percent"] for r in pie.values()) == pytest.approx(100.0)
    ex = P.sample_examples(df).collect()
    per_col = {}
    for r in ex:
        per_col.setdefault(r["column_name"], []).append(r["value"])
    assert len(per_col["s"]) == 3 and len(per_col["k"]) == 3               # fewer would be returned, never an error
    one = spark.createDataFrame([("only",)], "s string")
    assert P.sample_examples(one).count() == 1


def test_shape_preview_row_text(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.5)], "k long, s string, x double")
    assert P.shape(df).first().asDict() == {"rows": 2, "columns": 3}
    assert [r["k"] for r in P.preview(df, ["k"], 1).collect()] == [1]
    texts = sorted(r["t"] for r in df.select(P.row_text(df).alias("t")).collect())
    assert texts == ["1 a 1.5", "2 b"]
    assert P.table_word_count(df).first()["word_count"] == 5
    head = P.truncate_table_text(df, ["k"], 4).first()["text"]
    assert head == "1 a "


def test_table_report_has_all_parts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    rep = P.table_report(df)
    stats = {(r["column_name"], r["stat"]) for r in rep.collect()}
    assert ("*", "rows") in stats and ("p_size", "p50") in stats and ("p_brand", "top") in stats
    assert ("p_retailprice", "data_type") in stats
    assert rep.where(F.col("stat") == "rows").first()["value"] == str(df.count())


def test_large_values_and_empty_columns_stay(spark):
    df = spark.createDataFrame([(1e13, None, None), (3e13, None, None), (5e13, None, None)], "big double, none double, blank string")
    rows = {r["column_name"]: r for r in P.describe_all(df).collect()}
    assert (rows["big"]["mean"], rows["big"]["min"], rows["big"]["max"], rows["big"]["p50"]) == (3e13, 1e13, 5e13, 3e13)
    assert rows["none"]["count"] == 0 and rows["none"]["mean"] is None
    assert rows["blank"]["count"] == 0 and rows["blank"]["top"] is None
    assert {r["column_name"] for r in P.column_summary(df).collect()} == {"big", "none", "blank"}
    inf = spark.createDataFrame([(float("inf"),), (1.0,)], "x double")
    assert P.describe_numeric(inf).first()["max"] == float("inf")


def test_booleans_and_times_are_described(spark):
    df = spark.sql("select true as b, timestamp'2024-01-02 03:04:05' as t union all select true, null")
    rows = {r["column_name"]: r for r in P.describe_all(df).collect()}
    assert (rows["b"]["count"], rows["b"]["top"], rows["b"]["freq"]) == (2, "true", 2.0)
    assert rows["t"]["count"] == 1
