"""Cards C6 (keywords), C7 (pairing), BM25 vs brute force, splits and token arrays."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import defaults
from tessera.operators import retrieval as R
from tessera.operators import training as M


def test_keyword_semantics(spark):
    s = spark.createDataFrame([(1, "A part of it"), (2, "Nothing here"), (3, "The GDP grew"), (4, "art, Art")],
                              "id long, s string")
    kws = spark.createDataFrame([("art",), ("GDP",), ("art",)], "keyword string")
    got = sorted(r["id"] for r in R.keyword_match(s, "s", kws).collect())
    assert got == [1, 3, 4]            # substring ('part'), keywords lower-cased once, duplicates harmless
    whole = sorted(r["id"] for r in R.keyword_match(s, "s", kws, whole_word=True).collect())
    assert whole == [3, 4]
    # the fact path keeps the original list: capitalised keywords never match a lower-cased sentence
    df = spark.createDataFrame([("The GDP rose. Art fairs since 1990.",)], "t string")
    assert df.select(R.relevant_sentences(F.col("t")).alias("r")).first()["r"] == "Art fairs since 1990"


def test_alias_and_canned(spark):
    q = spark.createDataFrame([(1, "POTUS"), (2, "POTUS?"), (3, "Seven wonders of the world")], "id long, q string")
    out = {r["id"]: r for r in R.canned_answer(R.alias_lookup(q, "q")).collect()}
    assert out[1]["search_query"] == "President of the United States"
    assert out[2]["search_query"] == "POTUS"              # the key keeps its '?', so no alias
    assert out[3]["canned"] == defaults.CANNED_ANSWERS[0][1]


def _brute_bm25(queries, docs, k1=1.2, b=0.75):
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())  # noqa: E731 - letters/digits
    dt = {d: tok(t) for d, t in docs.items()}
    n, avgdl = len(dt), sum(len(v) for v in dt.values()) / len(dt)
    df = Counter(t for v in dt.values() for t in set(v))
    best = {}
    for qid, q in queries.items():
        scores = {}
        for d, toks in dt.items():
            tf = Counter(toks)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1)
                    / (tf[t] + k1 * (1 - b + b * len(toks) / avgdl)) for t in set(tok(q)) if tf[t])
            if any(tf[t] for t in set(tok(q))):
                scores[d] = round(s, 6)
        if scores:
            best[qid] = min(scores.items(), key=lambda kv: (-kv[1], kv[0]))
    return best


def test_bm25_matches_brute_force(spark):
    docs = {1: "the cat sat on the mat", 2: "dogs and cats", 3: "the the the", 4: "a mat for a cat",
            5: "unrelated words only"}
    queries = {10: "cat mat", 11: "the", 12: "zebra", 13: "Dogs?"}
    qd = spark.createDataFrame(list(queries.items()), "qid long, q string")
    dd = spark.createDataFrame(list(docs.items()), "doc long, t string")
    got = {r["qid"]: (r["doc_id"], r["score"]) for r in R.bm25_top1(qd, "qid", "q", dd, "doc", "t").collect()}
    want = _brute_bm25(queries, docs)
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6)


def test_fact_answer_tiers(spark):
    corpus = spark.createDataFrame([(1, "Mars is the fourth planet. It is red."), (2, "Jupiter facts\nmore")],
                                   "doc_id long, text string")
    qs = spark.createDataFrame([(1, "how many planets are there in the solar system"), (2, "mars"),
                                (3, "jupiter"), (4, "qqqq")], "id long, q string")
    out = {r["id"]: r for r in R.fact_answer(qs, "id", "q", corpus).collect()}
    assert out[1]["source"] == "canned"
    assert out[2]["source"] == "search" and out[2]["answer"] == "Mars is the fourth planet"
    assert out[3]["source"] == "first_line" and out[3]["answer"] == "Jupiter facts"
    assert out[4]["source"] == "general"


def test_correction_and_context(spark):
    corpus = spark.createDataFrame([(1, "Old text. He has served as mayor since 2001. End")], "doc_id long, text string")
    fb = spark.createDataFrame([(1, "mayor", False), (2, "mayor", True), (3, "zzz", None)],
                               "id long, q string, helpful boolean")
    out = {r["id"]: r["corrected"] for r in R.correct_answers(fb, "id", "q", corpus).collect()}
    assert out == {1: "He has served as mayor since 2001", 3: defaults.NO_BETTER_ANSWER}
    qs = spark.createDataFrame([(1, 1, "where is the red planet"), (2, 1, "anything")], "k long, t long, question string")
    ctx = spark.createDataFrame([(1, "Venus is hot. The red planet is Mars.")], "k long, context string")
    a = {r["k"]: r for r in R.answer_from_context(qs, ctx, "k").collect()}
    assert a[1]["answer"] == "The red planet is Mars." and a[1]["confidence"] == pytest.approx(0.8)  # 4 of 5 question terms
    assert a[2]["error"] == defaults.NO_CONTEXT_ERROR and a[2]["answer"] is None


def test_pairing_card(spark):
    rows = [  # q,q,a -> (first q, a); a first ignored; system between q and a ignored; a,a; q at the end
        (1, 0, "assistant", "lonely answer"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a1"),
        (1, 4, "user", "q3"), (1, 5, "system", "note"), (1, 6, "assistant", "a2"), (1, 7, "assistant", "a3"),
        (1, 8, "user", "  q4\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r["question"], r["answer"]) for r in M.pair_turns(df).orderBy("a_turn").collect()]
    assert got == [("q1", "a1"), ("q3", "a2")]


def test_speaker_lines(spark):
    lines = spark.createDataFrame([("f", 0, "Human 2: hi Human 2: again"), ("f", 1, "Human 1: hello"), ("f", 2, "x")],
                                  "path string, line_no long, text string")
    t = M.lines_to_turns(lines).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in t] == [("user", "hi  again"), ("assistant", "hello"), ("other", "x")]


def test_split_disjoint_complete_and_padding(spark):
    df = spark.range(2000).withColumn("question", F.lit("the cat")).withColumn("answer", F.lit("a mat here"))
    sp = M.train_eval_split(df, F.col("id"))
    chk = M.split_check(sp, F.col("id")).first()
    assert chk["n_overlap"] == 0 and chk["n_union"] == 2000 and chk["n"] == 2000
    assert 120 < chk["n_eval"] < 290                          # about 10%
    assert M.split_check(M.train_eval_split(df, F.col("id"), None), F.col("id")).first()["n_overlap"] == 2000
    vocab = M.build_vocab(df, ["question", "answer"], 3)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert set(ids.values()) == {2, 3, 4}
    lp = M.label_pairs(df.limit(3), "id", vocab, 8).collect()
    for r in lp:
        assert len(r["input_ids"]) == 8 and len(r["attention_mask"]) == 8 and len(r["labels"]) == 8
        assert r["attention_mask"] == [1, 1, 0, 0, 0, 0, 0, 0]
        # all words tie on count, so the vocabulary is (a, cat, here): "the" maps to the unknown id 1
        assert r["input_ids"][:2] == [M.UNK_ID, ids["cat"]] and r["input_ids"][2:] == [0] * 6


def test_words_are_looked_up_alike_in_the_row_and_by_a_join(spark):
    rows = [(1, "the cat The dog", None), (1, "", "a mat here"), (None, "dog " * 20, "x"), (None, None, "cat, cat! zebra")]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    vocab = spark.createDataFrame([("cat", 5), ("dog", 2), ("mat", 9)], "token string, id int")
    key = lambda r: tuple(map(repr, r))
    row, join = (sorted(map(key, M.label_pairs(df, "id", vocab, 6, vocab_size=n).collect())) for n in (3, None))
    assert row == join == sorted(map(key, [
        (1, [1, 5, 1, 2, 0, 0], [1, 1, 1, 1, 0, 0], [0] * 6), (1, [0] * 6, [0] * 6, [1, 9, 1, 0, 0, 0]),
        (None, [2] * 6, [1] * 6, [1, 0, 0, 0, 0, 0]), (None, [0] * 6, [0] * 6, [5, 5, 1, 0, 0, 0])]))
    none = spark.createDataFrame([], vocab.schema)
    assert M.tokenize_pad(df, "id", "question", none, 3, vocab_size=1).first()["input_ids"] == [1, 1, 1]
    assert M.label_pairs(df.limit(0), "id", vocab, 6, vocab_size=3).count() == 0
    plan = M.label_pairs(df, "id", vocab, 6, vocab_size=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def _py_pairs(rows):
    """The pairing rule as a sequential state machine (per conversation)."""
    out = []
    for conv in sorted({r[0] for r in rows}):
        pending = None
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            if role == "user" and pending is None:
                pending = (turn, text.strip())
            elif role == "assistant" and pending is not None:
                out.append((conv, pending[0], turn, pending[1], text.strip()))
                pending = None
    return sorted(out)


def test_pairing_is_chunk_invariant(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for conv in range(6):
        turn = 0
        for _ in range(rnd.randint(0, 40)):
            turn += rnd.randint(1, 3)                                   # sparse turn numbers
            rows.append((conv, turn, rnd.choice(["user", "user", "assistant", "assistant", "system"]), f"t{conv}-{turn} "))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = _py_pairs(rows)
    for chunk in (1, 2, 3, 7, 1 << 20):                                  # windows never cross a chunk
        got = sorted(tuple(r) for r in M.pair_turns(df, chunk_turns=chunk).collect())
        assert got == want, chunk


def test_one_failing_row_does_not_void_its_batch(spark):
    from tessera.operators.infer import batch_infer

    def factory():
        def model(texts):
            return [(str(10 // len(t)), 0.5) for t in texts]      # an empty text fails
        return model

    df = spark.createDataFrame([("ab",), ("",), ("abcde",)], "t string").coalesce(1)
    got = {r["t"]: (r["output"], r["confidence"], r["error"]) for r in batch_infer(df, "t", factory).collect()}
    assert got["ab"] == ("5", 0.5, None) and got["abcde"] == ("2", 0.5, None)
    assert got[""][0] is None and "ZeroDivisionError" in got[""][2]
