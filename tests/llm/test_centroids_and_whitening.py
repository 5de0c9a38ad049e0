"""Clustering and whitening against plain whole-number restatements."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, whitening
from tessera.llm.queries import op11_centroids, op12_whitening
from tessera.llm.tables import table

from .helpers import SF, clash

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(rows, clusters, rounds, scale, seed):
    """rows: (id, list of numbers) -> {position: (cluster, distance)}, centroids."""
    pts = [(i, [int(np.floor(scale * float(v))) for v in x]) for i, x in rows]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in pts if i is not None)[:clusters]
    cents = [x for _, x in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(cents)) for _, x in pts]

    for _ in range(rounds):
        who = [k for _, k in assign()]
        for k in range(len(cents)):
            mine = [x for (_, x), w in zip(pts, who) if w == k]
            if mine:
                cents[k] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(k, d) for d, k in assign()], cents


def odd_vectors(spark, dims, n=60, seed=3):
    """Ties, repeated rows and ids, null ids, broken vectors."""
    rng = np.random.default_rng(seed)
    rows = [(k, [float(v) for v in rng.integers(-3, 4, dims) / 4], 0) for k in range(n)]
    rows += [(n, rows[0][1], 1), (n, rows[1][1], 1), (None, rows[2][1], None), (None, [0.0] * dims, 2), (n + 1, [0.0] * dims, 2)]
    broken = [(n + 2, None, 0), (n + 3, [None] * dims, 0), (n + 4, [float("nan")] * dims, 0), (n + 5, [float("inf")] + [0.0] * (dims - 1), 0),
              (n + 6, [], 0), (n + 7, [1.0] * (dims - 1), 0)]
    return rows, spark.createDataFrame(rows + broken, SCHEMA)


def test_scan_equals_full_search():
    rng = np.random.default_rng(1)
    for k, dims, spread in ((1, 3, 4), (7, 5, 3), (40, 64, 60), (300, 16, 1000)):
        c = rng.integers(-spread, spread, (k, dims))
        c[k // 2] = c[0]
        x = np.concatenate([rng.integers(-spread, spread, (500, dims)), c, np.full((3, dims), 10**6)])
        who, dist, computed = centroids.nearest(x, c)
        full = ((x[:, None] - c) ** 2).sum(axis=2)
        assert (dist == full.min(axis=1)).all() and (who == full.argmin(axis=1)).all()
        assert computed <= len(x) * k
    assert computed < 0.9 * len(x) * k               # the bounds pass over centroids


def test_clusters_equal_plain_rounds(spark):
    rows, df = odd_vectors(spark, 6)
    out, cents = centroids.cluster_vectors(clash(df.repartition(5)), dims=6, clusters=7, rounds=3, scale=8)
    want, want_cents = lloyd([(i, x) for i, x, _ in rows], 7, 3, 8, 2)
    assert cents.tolist() == want_cents
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in want_cents]
    part = {k: sum(d for c, d in want if c == k) for k in range(7)}
    total = sum(d for _, d in want)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(
        ((i, c, d, part[c], total, digest[c]) for (i, _, _), (c, d) in zip(rows, want)), key=key)


def test_few_empty_and_too_large(spark):
    _, df = odd_vectors(spark, 6)
    assert centroids.cluster_vectors(df.limit(0), dims=6)[0].collect() == []
    assert centroids.cluster_vectors(df.where("vec_id is null"), dims=6)[0].where("cluster is null").count() == 2
    three, cents = centroids.cluster_vectors(df.where("vec_id < 3"), dims=6)
    assert len(cents) == 3 and three.agg(F.max("inertia")).first()[0] == 0
    with pytest.raises(Exception, match="exact distance"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 6, 0)], SCHEMA), dims=6)[0].collect()


def test_cluster_query_on_the_fixture(spark):
    out = op11_centroids(spark, SF)
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    want, cents = lloyd(rows, 40, 5, 256, 2)
    got = {r.vec_id: (r.cluster, r.distance, r.inertia) for r in out.collect()}
    total = sum(d for _, d in want)
    assert got == {i: (c, d, total) for (i, _), (c, d) in zip(rows, want)}


def test_scatter_is_exact():
    rng = np.random.default_rng(2)
    for rows, dims, lo, hi in ((1, 3, 0, 1), (64, 5, -3, 90), (1000, 7, 10**6, 10**6 + 200), (130, 4, -2**40, 2**40), (65, 2, 5, 6)):
        x = rng.integers(lo, hi, (rows, dims))
        s, cross = whitening.scatter(x)
        plain = x.astype(object)
        assert s.tolist() == plain.sum(axis=0).tolist() and cross.tolist() == (plain.T @ plain).tolist()


def check_whitened(out, rows, most, scale=64, offset=1_000_000):
    x = np.array([[int(np.floor(scale * float(np.float32(v)))) + offset for v in r[1]] for r in rows]).astype(object)
    n, s = len(x), x.sum(axis=0)
    got = out.orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    cov = np.array([[float(Fraction(int(n * (x[:, i] * x[:, j]).sum() - s[i] * s[j]), n * n)) for j in range(len(s))] for i in range(len(s))])
    values = np.linalg.eigvalsh(cov)[::-1]
    k = len(got[0].whitened)
    assert k == min(most, (values > 1e-10 * values[0]).sum())
    assert np.allclose(got[0].explained, values[:k] / np.trace(cov), rtol=1e-9)
    want = sorted(int(v) for v in ((n * x - s) ** 2).sum(axis=1))
    assert sorted(int(r.deviation) for r in got) == want and {r.n for r in got} == {n}
    white = np.array([r.whitened for r in got])
    measured = np.abs(np.cov(white.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert got[0].identity_error < 1e-4 and measured < 1e-4
    # whitened values are the centred rows on unit eigenvectors: they give the rows' distances back
    if k == len(s):
        dist = (white**2 * values[:k]).sum(axis=1)
        assert np.allclose(sorted(dist), [w / n**2 for w in want], rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    rows, df = odd_vectors(spark, 6)
    check_whitened(whitening.whiten(clash(df.repartition(4))), rows, 32)
    check_whitened(whitening.whiten(df, components=2), rows, 2)


def test_whitening_edge_tables(spark):
    _, df = odd_vectors(spark, 6)
    assert whitening.whiten(df.limit(0)).collect() == []
    same = spark.createDataFrame([(k, [0.5, 0.25], 0) for k in range(5)], SCHEMA)
    assert whitening.whiten(same).collect() == []
    flat = spark.createDataFrame([(k, [k / 64, k / 32, 1.0], 0) for k in range(50)], SCHEMA)
    assert {len(r.whitened) for r in whitening.whiten(flat).collect()} == {1}     # one direction varies
    wide = spark.createDataFrame([(k, [float(k * 10**6), float((k * k) % 7)], 0) for k in range(40)], SCHEMA)
    check_whitened(whitening.whiten(wide), [(k, [k * 10**6, (k * k) % 7]) for k in range(40)], 32)


def test_whitening_query_on_the_fixture(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    check_whitened(whitening.whiten(table(spark, SF, "embeddings")), rows, 32)
    out = op12_whitening(spark, SF)
    assert out.count() == 32 * len(rows) and out.select("vec_id", "component").distinct().count() == 32 * len(rows)
    assert out.agg(F.min("component"), F.max("component")).first()[:] == (1, 32)
