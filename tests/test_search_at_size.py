"""BM25 over rows of counts: the work of a query in a block, slices of tokens, words of any number."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import retrieval as R
from tessera.operators.blockmax import Block, count_terms, token_slices

from test_reports_and_search import brute_bm25


def test_long_queries_read_few_postings_of_a_block():
    """Common terms make up most postings of a long question; they are looked up for few documents."""
    rng = np.random.default_rng(3)
    n, terms = 16_000, 3000
    p = 1 / np.arange(1, terms + 1)
    p /= p.sum()
    size = np.minimum(rng.lognormal(5.5, 1, n).astype(int) + 3, 4000)
    doc, term = np.repeat(np.arange(n), size), rng.choice(terms, size.sum(), p=p)
    key, tf = np.unique(doc * terms + term, return_counts=True)
    doc, term = np.divmod(key, terms)
    df = np.bincount(term, minlength=terms)
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5))[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[doc] / size.mean()))
    block, order = Block(doc, term, weight, n), np.argsort(term, kind="stable")
    starts = np.append(0, np.cumsum(df))
    reads, touched = 0, 0
    for _ in range(40):
        wanted = np.unique(rng.choice(terms, 40, p=p))
        total = np.zeros(n)
        for t in wanted:
            own = order[starts[t]:starts[t + 1]]
            total[doc[own]] += weight[own]
        docs, sums, read = block.best(wanted)
        assert sums.max() == pytest.approx(total.max()) and total[docs[sums.argmax()]] == pytest.approx(total.max())
        reads, touched = reads + read, touched + df[wanted].sum()
    assert reads < 0.14 * touched


def _corpus():
    rng = random.Random(11)
    text = lambda k: " ".join(f"w{min(int(rng.expovariate(0.06)), 79)}" for _ in range(k))
    docs = [(k, text(rng.randint(0, 30))) for k in range(120)] + [(500, None), (501, ""), (None, "zz of no question")]
    return docs, [(f"q{k}", text(rng.randint(0, 12))) for k in range(30)] + [("none", "unheard of"), ("null", None)]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_words_held_by_workers_or_joined(spark, monkeypatch, limit):
    """0: the words of the questions are too many to hold, so that they meet the corpus in a join."""
    docs, queries = _corpus()
    d, q = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(queries, "qid string, q string")
    monkeypatch.setattr(R, "MAX_BROADCAST_ROWS", limit)
    want = brute_bm25(queries, docs)
    got = {r.qid: (r.doc_id, r.score) for r in R.bm25_top1(q, "qid", "q", d, "doc", "t", block_postings=200, batch_terms=60).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_rows_of_one_id_and_length_are_one_document(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "MAX_BROADCAST_ROWS", limit)
    rows = [(1, "fox den"), (1, "fox hen"), (1, "one fox den"), (2, "fox fox"), (3, "hen sea"), (4, "sea sea"), (None, "fox den")]
    d, q = spark.createDataFrame(rows, "doc long, t string"), spark.createDataFrame([(1, "fox"), (2, "hen den"), (3, "sea")], "qid long, q string")
    got = {r.qid: (r.doc_id, r.score) for r in R.bm25_top1(q, "qid", "q", d, "doc", "t").collect()}
    avgdl, n = 15 / 7, 7
    counts = Counter((i, w, len(t.split())) for i, t in rows if i is not None for w in t.split())      # rows of one id and length are counted together
    df = Counter(w for _, w, _ in counts)
    want = {}
    for k, text in ((1, "fox"), (2, "hen den"), (3, "sea")):
        score = Counter()
        for (i, w, dl), tf in counts.items():
            if w in text.split():
                score[i] += np.log(1 + (n - df[w] + .5) / (df[w] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / avgdl))
        want[k] = min((-round(s, 6), i) for i, s in score.items())
    assert got == {k: (i, pytest.approx(-s, abs=1e-6)) for k, (s, i) in want.items()}


def test_a_document_is_one_row_between_corpus_and_blocks(spark, monkeypatch):
    """Not a row for each word of it, copied for each batch of questions."""
    seen = {}
    written = R._written
    monkeypatch.setattr(R, "_written", lambda df, name: seen.setdefault(name, written(df, name)))
    docs, queries = _corpus()
    d, q = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(queries, "qid string, q string")
    R.bm25_top1(q, "qid", "q", d, "doc", "t")
    assert seen["counts"].count() == len(docs)


def test_slices_of_tokens_are_bounded_and_whole():
    lists = [["a"] * k if k is not None else None for k in (3, 4, None, 0, 25, 1, 2, 9, 10, 0)]
    batch = lambda a, z: pa.RecordBatch.from_arrays([pa.array(range(a, z)), pa.array(lists[a:z], pa.list_(pa.string()))], names=["doc", "_toks"])
    found = list(token_slices([batch(0, 4), batch(4, 4), batch(4, 9), batch(9, 10)], 10))
    assert [k for t in found for k in t["doc"].to_pylist()] == list(range(10))
    assert all(sum(len(x or ()) for x in t["_toks"].to_pylist()) <= 10 or len(t) == 1 for t in found)
    assert [t["doc"].to_pylist() for t in found][0] == [0, 1, 2, 3]
    got = count_terms(pa.table({"doc": pa.array([7, None, 8, 9]), "_toks": pa.array([["x", "y", "x"], ["x"], None, []], pa.list_(pa.string()))}),
                      pa.array(["x", "z"]), np.array([5, 6], np.int32)).to_pylist()
    assert got == [{"doc": 7, "dl": 3, "n_rows": 1, "t": [5], "tf": [2]}, {"doc": None, "dl": 1, "n_rows": 1, "t": [], "tf": []},
                   {"doc": 8, "dl": None, "n_rows": 1, "t": [], "tf": []}, {"doc": 9, "dl": 0, "n_rows": 1, "t": [], "tf": []}]
