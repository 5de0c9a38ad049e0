"""Word weights and summaries where the text is, files by lines, examples by top-k."""
import os

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.operators.infer import map_batches
from tessera.operators.text import _shared_frequencies, extractive_summary, word_frequencies
from tessera.plans.documents import text_report
from tessera.sources import files as S

ODD = ["cars car Cars CAR's car's 12 x's a ass asses red car red cars red Cars red CARs s s's ss ½½ ٣٤ ΟΔΟΣ οδος İstanbul 一二 _x __",
       "", None, "Ab ab AB bus buss buses 3d 3D. Next one. . x", "the of and", "good tea good tea good tea. Green teas, good teas"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_with_their_own_id_are_weighed_without_a_shuffle(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    for collocations in (False, True):
        own = word_frequencies(df, "id", collocations=collocations, threshold=2.0)
        assert "Exchange" not in _plan(own) and "Sort" not in _plan(own)
        shared = _shared_frequencies(df, "id", "text", None, None, None, collocations, 2.0)
        assert sorted(map(repr, own.collect())) == sorted(map(repr, shared.collect()))


def test_rows_that_share_an_id_are_one_text(spark):
    df = spark.createDataFrame([(1, "cat cat"), (1, "cat dog"), (None, "fish"), (None, "fish"), (2, "cat")], "id long, text string")
    out = {(r.id, r.term): (r.n, r.rank) for r in word_frequencies(df, "id").collect()}
    assert out == {(1, "cat"): (3, 1), (1, "dog"): (1, 2), (None, "fish"): (2, 1), (2, "cat"): (1, 1)}


def test_summaries_and_reports_move_nothing(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    for out in (extractive_summary(df, "id"), text_report(df, "id")):
        assert "Exchange" not in _plan(out) and "Sort" not in _plan(out)
    rows = {r.id: r for r in extractive_summary(df, "id", budget=2).collect()}
    assert sorted(rows) == [0, 3, 4, 5] and rows[4].summary == "the of and."
    stops = spark.createDataFrame([("B2",), (None,)], "word string")
    two = spark.createDataFrame([(1, "a1 a1. b2 b2 b2")], "id long, text string")
    assert extractive_summary(two, "id", budget=2, stop_words=stops).first().summary == "a1 a1."
    assert extractive_summary(two, "id", budget=2).first().summary == "b2 b2 b2."


def test_text_totals_of_files_in_any_form(spark, tmpdir_path):
    texts = {"a b.txt": "one two\n\nthree", "c+d.txt": "é\n", "e.txt": "﻿mark", "f%41.txt": "﻿mark\n", "g.txt": "\r\n x \r"}
    for name, text in texts.items():
        with open(os.path.join(tmpdir_path, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    with open(os.path.join(tmpdir_path, "bad.txt"), "wb") as f:
        f.write(b"ok\n\xff\xfe\n")
    whole = S.scan_text(spark, tmpdir_path).select("path", F.length("text").alias("n"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w"), "error")
    want = {os.path.basename(r.path): (r.n, None if r.error else r.w, r.error) for r in whole.collect()}
    got = {os.path.basename(r.path): (r.n_chars, r.word_count, r.error) for r in S.text_totals(S.scan_text(spark, tmpdir_path, lines=True)).collect()}
    assert got == want and len(got) == 6 and "bad.txt" in got and got["e.txt"] == (5, 1, None)
    assert "binaryFile" not in _plan(S.text_totals(S.scan_text(spark, tmpdir_path, lines=True)))


def test_examples_sort_no_whole_column(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 2 as string) as s", "cast(null as string) as n")
    plan = _plan(P.sample_examples(df))                   # the column of nulls needs no job
    assert plan.count("TakeOrderedAndProject") == 2 and "WindowGroupLimit" not in plan
    out = sorted((r.column_name, r.ordinal, r.value) for r in P.sample_examples(df).collect())
    h = lambda c: F.md5(F.concat(F.lit(f"42:{c}:"), F.col(c).cast("string")))
    want = [("id", i + 1, str(r.id)) for i, r in enumerate(df.orderBy(h("id")).limit(3).collect())]
    assert [o for o in out if o[0] == "id"] == want and len([o for o in out if o[0] == "s"]) == 3


def test_map_batches_take_bounded_rows(spark):
    sizes = map_batches(spark.range(5000).coalesce(1), lambda p: p.iloc[:1].assign(id=len(p)), "id long").collect()
    assert max(r.id for r in sizes) <= 1000 and sum(r.id for r in sizes) == 5000
