import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, licenses, quality

from .helpers import SF, clash, docs, lower_ascii, odd_rows, sentence

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bigrams(text):
    w = W.findall(lower_ascii(text))
    return set(zip(w, w[1:]))


def dice_matches(text, templates=licenses.TEMPLATES, least=0.8):
    text = text or ""
    segments = [(k, bigrams(x)) for k, x in enumerate(text.split("\n"))]
    if sum(bool(W.findall(lower_ascii(x))) for x in text.split("\n")) > 1:
        segments.append((-1, bigrams("\n".join(text.split("\n")))))
    out = []
    for k, s in segments:
        for name, t in templates:
            both = bigrams(t)
            if s and both and 2 * len(s & both) / (len(s) + len(both)) >= least:
                out.append((-2 * len(s & both) / (len(s) + len(both)), name, k))
    return sorted(out), sum(bool(s) for _, s in segments)


def test_licenses_equal_brute_force(spark):
    mit = "Released under the MIT License."
    rows = odd_rows() + [
        (50, mit), (51, f"some words before\n{mit.upper()}\nand after"), (52, "Licensed under the Apache License, Version 2.0!\n" + mit),
        (53, "Licensed under the Apache License, Version 2.1"), (54, "This library is free software; you can redistribute it\n"
         "under the terms of the GNU Lesser General Public License, version 2.1."), (55, "Released under the"), (56, mit + "\n" + mit)]
    got = licenses.scan_licenses(clash(docs(spark, rows))).collect()
    want = sorted((repr(i), repr(dice_matches(t))) for i, t in rows)
    assert sorted((repr(r.doc_id), repr(([(-m.dice, m.license, m.line) for m in r.licenses], r.n_segments))) for r in got) == want
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    by = {r.doc_id: [m.license for m in r.licenses] for r in got}
    assert by[50] == ["mit"] and by[54] == ["lgpl-2.1"] and by[1] == [] and "apache-2.0" in by[52] and "mit" in by[52]


def test_license_query_against_brute_force(spark):
    from tessera.llm.queries import op8_licenses
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op8_licenses(spark, SF).collect():
        found, n = dice_matches(texts[r.doc_id])
        assert (r.n_segments, r.n_matches, r.license) == (n, len(found), found[0][1] if found else None)


def test_language_accuracy_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = table.where("doc_id % 2 = 0"), table.where("doc_id % 2 = 1")
    langs, model = langid.train(train)
    none = F.lit(None).cast("string")
    rows = test.select(F.col("doc_id").alias("id"), "text", none.alias("declared"), none.alias("suffix"),
                       F.col("source").alias("host"), none.alias("domain"))
    got = langid.identify(rows, langs, model).join(test.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth")), "id")
    assert got.where("accepted and lang = truth").count() >= 0.98 * test.count()


def test_rare_languages_train_and_samples_stay_bounded(spark):
    """One language holds nearly all rows, many of them copies; a share of all
    rows would leave the others out."""
    rng = random.Random(13)
    rows = [(k, sentence(rng, 8), "en") for k in range(3000)] + [(5000 + k, "one copy of a text", "en") for k in range(500)]
    rows += [(7000, "ñandú así él está aquí", "es"), (7001, "größe für straße", "de"), (7002, "größe für straße", "de")]
    langs, table = langid.train(docs(spark, rows), train_rows=30)
    assert langs == ["de", "en", "es"] and table.shape[1] == 4
    few, _ = langid.train(docs(spark, rows), train_rows=1)
    assert few == ["de", "en", "es"]


def test_training_shares():
    assert langid.even_share([10, 1000, 1000], 110) == 50 and langid.even_share([3, 4], 100) >= 4
    assert langid.even_share([7] * 50, 5) == 1 and langid.even_share([], 5) == 1
    n = 10 ** 13                                       # rows of a table whose share of 2**20 would be 0
    assert 5999 <= langid.hash_limit(6000, n) * n / 2 ** 63 <= 6001 and langid.hash_limit(5, 5) == 2 ** 63 - 1


def test_texts_without_labels_are_an_error(spark):
    with pytest.raises(ValueError, match="label"):
        langid.train(docs(spark, [(1, "some text", None)]))
    assert langid.train(docs(spark, [(1, None, None)]))[0] == []


def test_more_labels_than_a_model_holds_are_an_error(spark):
    rows = docs(spark, [(k, f"text number {k}", f"l{k % 5}") for k in range(20)])
    assert len(langid.train(rows, max_languages=5)[0]) == 5
    with pytest.raises(ValueError):
        langid.train(rows, max_languages=4)


def test_grades_out_of_range_do_not_train(spark):
    rows = docs(spark, [(k, f"{'good fine' if k % 2 else 'bad poor'} word{k % 7} text") for k in range(60)])
    rated = [(k, k % 2) for k in range(60)]
    odd = [(100, 0), (3, -1), (5, 7), (None, 1), (9, None)]
    schema = "doc_id long, grade int"
    a = quality.train(rows, spark.createDataFrame(rated, schema), 2)
    b = quality.train(rows, spark.createDataFrame(rated + odd, schema), 2)
    assert (a.thresholds == b.thresholds).all() and (a.weights == b.weights).all()
    none = quality.train(rows, spark.createDataFrame([(1, 9), (2, -3)], schema), 2)
    assert quality.score(rows, none, 1).count() == 60


def test_evidence_decides_where_the_text_does_not(spark):
    langs, model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    table = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200").collect()
    pages = [(k, f"<html lang='{r.lang}'><body>{r.text}</body></html>", f"http://www.site-{r.lang}.test/{k}") for k, r in enumerate(table)]
    pages += [(1000, "<html lang=de><p>zz</p></html>", "http://www.site-de.test/a"), (1001, "<html><p>zz</p></html>", "http://www.site-fr.test/b"),
              (1002, None, None), (1003, "", "no address"), (1004, "<p>12 34</p>", "http://www.site-en.test/c")]
    frame = spark.createDataFrame(pages, "page_id long, html string, url string")
    got = {r.id: r for r in langid.identify(langid.page_rows(frame), langs, model).collect()}
    assert len(got) == len(pages)
    assert got[1000].lang == "de" and got[1001].lang == "fr"
    for k in (1002, 1003, 1004):
        assert (got[k].lang, got[k].posterior, got[k].accepted) == ("und", 1.0, False)
    assert got[1000].declared == "de" and got[1000].domain == "site-de.test" and got[1000].suffix == "test"


def test_rejected_documents_go_and_columns_stay(spark):
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = base + [(9001, None), (9002, ""), (9003, "12 34 !!"), (None, base[0][1], base[0][2], base[0][3]),
                   (9004, "qzx xqz zqx jxq qjz zxj qxz vqx zzq xjq " * 20, None)]
    table = clash(docs(spark, rows))
    kept = langid.keep_identified(table)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.schema.names == table.schema.names
    assert {r[0] for r in base} <= set(ids) and None in ids and not {9001, 9002, 9003, 9004} & set(ids)
    assert langid.keep_identified(docs(spark, [])).count() == 0


def graded(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    ratings = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.expr(
        "case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end").alias("grade"))
    return table, ratings


def test_quality_on_held_out_ratings(spark):
    table, ratings = graded(spark, "/root/testdata/sf0.1")
    model = quality.train(table, ratings.where("doc_id % 4 <> 0"), 3, train_rows=3000)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = quality.score(table, model, 2).join(ratings.where("doc_id % 4 = 0"), "doc_id").toPandas()
    assert (got.selected == (got.grade == 2)).mean() > 0.95
    assert got[got.grade == 2].selected.mean() > 0.97
    means = got.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]


def test_quality_of_odd_rows(spark):
    table, ratings = graded(spark, SF)
    model = quality.train(table, ratings.unionByName(ratings.limit(5)).unionByName(
        spark.createDataFrame([(None, 1), (3, None), (99999, 2)], "doc_id long, grade int")), 3)
    rows = odd_rows()
    got = quality.score(clash(docs(spark, rows)), model, 2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1
        if r.doc_id in (1, 2, 3):
            assert not r.selected
    assert quality.score(docs(spark, []), model, 2).count() == 0


def test_ordinal_probabilities_sum_to_one():
    rng = np.random.RandomState(0)
    rows = [(np.unique(rng.randint(0, 50, 8)).astype(np.int32), None) for _ in range(300)]
    rows = [(i, np.ones(len(i), np.float32)) for i, _ in rows]
    grades = np.array([min(3, int((i < 10).sum())) for i, _ in rows])
    model = quality.Ordinal.fit(rows, grades, 4)
    p = model.grade_probabilities(rows)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert (p.argmax(axis=1) == grades).mean() > 0.8
