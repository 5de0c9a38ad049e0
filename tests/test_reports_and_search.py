"""Reports by row, long sentences, lexicon tables, and search by block bounds."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import defaults
from tessera.operators.blockmax import Block
from tessera.operators.relational import PIXEL_GROUP, metadata_map
from tessera.operators.retrieval import bm25_top1
from tessera.operators.sentiment import sentiment_scores
from tessera.operators.text import extractive_summary
from tessera.plans.documents import document_report, text_report
from tessera.plans.pages import page_report
from tessera.session import spread

GOOD, BAD = "A very good day. It was great!", "Not good at all. A terrible, horrible mess."


def test_every_row_has_its_own_report(spark):
    rows = [(None, "text", GOOD), (None, "text", BAD), (7, "text", GOOD), (7, "text", BAD), (8, "text", None), (9, "video", GOOD), (10, "text", GOOD)]
    out = document_report(spark.createDataFrame(rows, "doc_id long, type string, text string")).collect()
    assert len(out) == len(rows)
    by = lambda i: sorted(r.compound for r in out if r.doc_id == i)
    assert by(None) == by(7) and by(7)[0] < 0 < by(7)[1]
    one = {r.doc_id: r for r in out}
    assert one[10].summary and one[10].top_terms and one[8].summary is None and one[9].error


def test_pages_that_share_an_id_or_have_none(spark):
    html = lambda t: f"<html><body><p>{t}</p></body></html>"
    rows = [(None, "u", html(GOOD)), (None, "u", html(BAD)), (3, "u", html(GOOD)), (3, "u", html(BAD)), (4, "u", None)]
    out = page_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 5
    assert sorted(r.sentiment.compound for r in out if r.page_id is None) == sorted(r.sentiment.compound for r in out if r.page_id == 3)
    assert all(r.summary for r in out if r.page_id != 4) and [r.error for r in out if r.page_id == 4] == ["No text found on the page."]


def test_a_table_gives_the_scores_of_the_constants(spark):
    rng = random.Random(4)
    words = [r[0] for r in defaults.lexicon_rows()] + ["so", "this", "doubt", "without", "but", "day", "AND", "at"]
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "!", "?? !!", "."])
             for _ in range(120)]
    df = spark.createDataFrame([(k % 50, t) for k, t in enumerate(texts)] + [(None, None), (None, "")], "id long, text string")
    key = lambda r: tuple(map(repr, r))
    own = sorted(map(key, sentiment_scores(df, "id").collect()))
    table = sorted(map(key, sentiment_scores(df, "id", lexicon=defaults.lexicon_df(spark)).collect()))
    assert own == table and len(own) == 122


def test_one_sentence_of_very_many_words(spark):
    rng = random.Random(5)
    long_ = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(20_000))
    df = spark.createDataFrame([(1, long_), (1, "Short one. Another short one."), (None, "Only one")], "id long, text string")
    extractive_summary(df.limit(1), "id").count()
    start = time.time()
    out = extractive_summary(df, "id").collect()
    assert time.time() - start < 20
    assert sorted((r.n_sentences, len(r.summary)) for r in out if r.id == 1)[-1][0] == 2
    assert {r.summary for r in out if r.id is None} == {"Only one."}
    report = text_report(df, "id", "text")
    assert report.count() == 3 and report.agg(F.max("word_count")).first()[0] == 20_000


def test_block_bounds_keep_the_best_document():
    rng = np.random.default_rng(6)
    for case in range(30):
        n, terms = int(rng.integers(1, 4000)), int(rng.integers(1, 40))
        doc, term = rng.integers(0, n, 6 * n), (rng.zipf(1.4, 6 * n) - 1) % terms
        weight = rng.random(6 * n) * (1 + rng.integers(0, 5, terms))[term]
        block = Block(doc, term, weight, n)
        wanted = np.unique(rng.integers(0, terms + 5, rng.integers(1, 12)))
        total = np.zeros(n)
        at = np.isin(term, wanted)
        np.add.at(total, doc[at], weight[at])
        docs, sums, read = block.best(wanted)
        assert read <= max(at.sum(), 1) * 2
        if not total.any():
            assert not len(docs)
            continue
        best = int(total.argmax())
        assert best in docs and np.allclose(sums, total[docs]) and sums.max() == pytest.approx(total.max())


def brute_bm25(queries, docs, k1=1.2, b=0.75):
    toks = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    all_ = [(i, toks(t)) for i, t in docs]
    n, avg = len(all_), sum(len(t) for _, t in all_) / sum(t is not None for _, t in docs)      # a null text has no length
    found = {}
    for q, text in queries:
        best = None
        for i, t in all_:
            score = 0.0
            for w in set(toks(text)):
                df, tf = sum(w in x for _, x in all_), t.count(w)
                if tf:
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
            score = math.floor(score * 1e6 + 0.5) / 1e6
            if score and i is not None and (best is None or (-score, i) < best):
                best = (-score, i)
        if best:
            found[q] = (best[1], -best[0])
    return found


def test_search_over_many_blocks_and_batches(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(vocab[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))
    docs = [(k, text(rng.randint(0, 40))) for k in range(150)] + [(200 + k, "w1 w2 w50") for k in range(5)] + [(300, None), (301, "")]
    queries = [(k, text(rng.randint(0, 9))) for k in range(40)] + [(50, "w1 w2 w50"), (51, None), (52, "nothing like it")]
    d, q = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(queries, "qid long, q string")
    want = brute_bm25(queries, docs)
    for options in ({}, {"block_postings": 100, "batch_terms": 30}):
        got = {r.qid: (r.doc_id, r.score) for r in bm25_top1(q, "qid", "q", d, "doc", "t", **options).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert bm25_top1(q, "qid", "q", d.limit(0), "doc", "t").count() == 0


def test_small_tables_are_dealt_over_the_cores(spark):
    df = spark.range(1000).coalesce(1)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
        assert spread(df) is df
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_the_last_of_repeated_tags_wins(spark):
    rows = [(1, 16, "Name", "b", 1), (1, 16, "Name", "a", 2), (1, 32, "Date", None, 3), (1, 16, None, "x", 4), (2, PIXEL_GROUP, "Pixels", "z", 1),
            (None, 16, "Name", "q", 1)]
    tags = spark.createDataFrame(rows, "doc long, grp int, name string, value string, at int")
    found = {r.doc: r.metadata for r in metadata_map(tags, "doc", "grp", "name", "value", order_col="at").collect()}
    assert found == {1: {"Name": "a", "Date": None}, None: {"Name": "q"}}
    assert {r.doc: r.metadata["Name"] for r in metadata_map(tags, "doc", "grp", "name", "value").collect()} == {1: "b", None: "q"}


def test_search_tokenises_the_corpus_once(spark, tmp_path):
    """N, avgdl and the postings come from one pass: odd rows count in N, a text without words has length 0."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(1, "red fox"), (2, "red red hen pie"), (2, "fox"), (None, "red sea of long words"), (3, None), (4, ""), (5, "fox fox den")]
    corpus = spark.createDataFrame(rows, "doc long, t string")
    q = spark.createDataFrame([("a", "red hen"), ("b", "fox"), ("c", "nothing"), ("d", "")], "qid string, q string")
    got = {r.qid: (r.doc_id, r.score) for r in bm25_top1(q, "qid", "q", corpus.mapInArrow(seen, corpus.schema), "doc", "t").collect()}
    assert read.value == len(rows)
    sizes = [len(t.split()) for _, t in rows if t is not None]
    avgdl, n = sum(sizes) / len(sizes), len(rows)
    part = lambda df, tf, dl: math.log(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / avgdl))
    assert got["a"] == (2, round(part(2, 2, 4) + part(1, 1, 4), 6))
    best = {1: part(3, 1, 2), 2: part(3, 1, 1), 5: part(3, 2, 3)}
    assert got["b"] == (max(best, key=best.get), round(max(best.values()), 6)) and set(got) == {"a", "b"}
