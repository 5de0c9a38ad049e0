import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp

from .helpers import SF, clash, docs, odd_rows, sentence


def paragraphs(text):
    return {p for p in re.split(r"[\r\n]+|(?<=[.!?])[ \t]+", text) if p.strip(" ")}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Results in ascending id (null first, equal ids in any order of equal texts)."""
    out = []
    for k, (i, text) in enumerate(rows):
        x, y = text or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(x) // 2
        edited = x[:len(x) - h] + y[:h]
        a = paragraphs(x)
        out.append((repr(i), len(x), hashlib.sha256(edited.encode()).hexdigest(), len(a),
                    round(likeness(a, paragraphs(edited)), 9), round(likeness(a, paragraphs(y)), 9)))
    return sorted(out)


def result(df):
    return sorted((repr(r.doc_id), r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), r.n_paragraphs,
                   round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def fixture():
    rng = random.Random(31)
    rows = [r for r in odd_rows() if r[0] not in (None, 8)]
    shared = [sentence(rng, 6) + "." for _ in range(30)]
    for k in range(60):
        rows.append((100 + 7 * k, "\n".join(rng.choice(shared) if rng.random() < 0.5 else sentence(rng, 5) + "! " + sentence(rng, 4)
                                            for _ in range(rng.choice([0, 1, 3, 12, 60, 300])))))
    return sorted(rows)


@pytest.mark.parametrize("per", [4, 256])
def test_equal_brute_force(spark, monkeypatch, per):
    monkeypatch.setattr(fp, "RANGE", per)
    rows = fixture()
    assert result(fp.fingerprints(clash(docs(spark, rows)))) == brute(rows)


def test_cells_of_clustered_null_and_repeated_ids_stay_small(spark):
    """Outliers, clusters, extremes, one id and null ids with many texts: no
    cell above the bound, and the cells are in the order of the ids."""
    ids = [*range(20_000), 10**12, -(1 << 63), (1 << 63) - 1, *((i % 5) * 10**9 + i for i in range(5_000)), *(1 << i for i in range(62))]
    rows = [(i, f"text {n}") for n, i in enumerate(ids)] + [(77, f"same id {i}") for i in range(4_000)] + [(None, f"no id {i}") for i in range(4_000)]
    dealt, counted = fp.cells(docs(spark, rows).select("doc_id", "text"), 256)
    sizes = counted.collect()
    assert sum(c.n for c in sizes) == len(rows) and max(c.n for c in sizes) <= 4 * 256
    placed = sorted((d.given, d.k, d.h, (d.given, d["at"], d.part)) for d in dealt.collect())
    assert [p[3] for p in placed] == sorted(p[3] for p in placed)
    got = fp.followed(docs(spark, rows).select("doc_id", "text")).groupBy("in_range").count().collect()
    assert {r.in_range: r["count"] for r in got} == {0: len(rows), 1: len(sizes)}


def test_sketches_peel_and_retry(spark):
    """The number of differing digests is right at every size of difference,
    with the smallest sketch where it suffices."""
    rng = random.Random(2)
    cases = []
    for n in (0, 1, 2, 5, 10, 14, 40, 200, 1500):
        common = [sentence(rng, 3) for _ in range(50)]
        a, b = [sentence(rng, 3) for _ in range(n)], [sentence(rng, 3) for _ in range(n // 2)]
        cases.append((n, "\n".join(common + a), "\n".join(b + common), n + n // 2))
    df = (spark.createDataFrame(cases, "n int, x string, y string, want int")
          .withColumn("a", F.expr(fp.paragraphs("x"))).withColumn("b", F.expr(fp.paragraphs("y")))
          .withColumn("first", F.expr(fp.peel(fp.subtract(fp.sketch("a"), fp.sketch("b")))))
          .withColumn("got", F.expr(fp.difference("first", "a", "b"))))
    for r in df.collect():
        assert r.got == r.want and r.first in (r.want, -1)
        assert r.first == r.want if r.n <= 2 else r.n < 40 or r.first == -1


def test_equal_texts_have_equal_fingerprints_and_ties_repeat(spark):
    rows = [(1, "a b. c d.\ne"), (2, "a b. c d.\ne"), (2, "a b. c d.\ne"), (3, None), (4, ""), (None, "x"), (9, "a b. c d.\nf")]
    got = fp.fingerprints(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint
    assert by[1].near_next == 1.0 and by[1].fingerprint != by[9].fingerprint and by[3].near_next == 1.0
    assert by[9].edited == "a b. c" + "x" and by[3].edited == ""


def test_one_row_and_none(spark):
    (r,) = fp.fingerprints(docs(spark, [(5, "one. two.")])).collect()
    assert (r.edited, r.near_next) == ("one. one.", 1.0)
    assert fp.fingerprints(docs(spark, [])).count() == 0


def test_query_against_brute_force(spark):
    from tessera.llm.queries import op1_fingerprints
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = {w[0]: w for w in brute(rows)}
    for r in op1_fingerprints(spark, SF).collect():
        _, n, sha, _, edited, next_ = want[repr(r.doc_id)]
        assert (r.n_chars, r.edited_sha256) == (n, sha) and len(r.fingerprint) == 384
        assert (round(r.near_edited, 9), round(r.near_next, 9)) == (edited, next_)


def test_only_spark_functions(spark):
    plan = fp.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
