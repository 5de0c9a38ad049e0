"""Near-duplicate vectors against all pairs compared in double precision."""

import numpy as np
import pytest

from tessera.llm import flatgraph, vectordup

from .helpers import clash

SCHEMA = "vec_id long, embedding array<float>, label int"


def truth(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    x = [None if v is None or any(e is None or not np.isfinite(e) for e in v) or not any(v) else np.array(v, np.float32).astype(float)
         for _, v, _ in rows]
    n = len(rows)
    linked = [[i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j])
               and (x[i] @ x[j]) / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= threshold for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = [j for j in range(n) if linked[k][j] and j not in seen]
            seen.update(new), todo.extend(new)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], sum(linked[i]), least, least is None or rows[i][0] == least))
    return sorted(out, key=str)


def near(rng, v, cos):
    z = rng.normal(size=len(v))
    v = v / np.linalg.norm(v)
    z -= (z @ v) * v
    return cos * v + np.sqrt(1 - cos**2) * z / np.linalg.norm(z)


def make_rows(rng, dims, n, planted, group, fringe=0):
    """Random vectors, near copies of some, one group of near copies of one vector
    and vectors around that group at every distance."""
    x = [rng.normal(size=dims) for _ in range(n)]
    x += [near(rng, x[k], rng.uniform(0.86, 0.97)) * rng.uniform(0.1, 9) for k in range(planted)]
    heart = rng.normal(size=dims)
    x += [near(rng, heart, 0.994) for _ in range(group)] + [near(rng, heart, rng.uniform(0.75, 0.98)) for _ in range(fringe)]
    return [(k, [float(np.float32(e)) for e in v], 0) for k, v in enumerate(x)]


def got(out):
    return sorted((tuple(r)[:4] for r in out.collect()), key=str)


def test_odd_rows_and_cores_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = make_rows(rng, 16, 120, 40, 40, 60)
    rows += [(500, rows[0][1], 1), (501, rows[0][1], 2), (500, rows[3][1], 0), (None, rows[5][1], 0), (None, [9.0] * 16, 0),
             (502, None, 0), (503, [], 0), (504, [0.0] * 16, 0), (505, [None] * 16, 0), (506, [float("nan")] * 16, 0), (507, [float("inf")] * 16, 0),
             (508, [1.0, 2.0], 0), (509, [2.0, 4.0], 0), (510, [1e-30] * 16, 0), (511, [3e38] * 16, 0)]
    df = clash(spark.createDataFrame(rows, SCHEMA).repartition(4))
    out = vectordup.near_duplicate_vectors(df)
    assert got(out) == truth(rows)
    assert out.select("audited_recall").distinct().first()[0] == 1.0


def test_no_rows_and_one_row(spark):
    assert vectordup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    one = vectordup.near_duplicate_vectors(spark.createDataFrame([(4, [1.0, 2.0], 0)], SCHEMA))
    assert got(one) == [(4, 0, 4, True)]
    with pytest.raises(ValueError):
        vectordup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA), rho=0.95)


def test_shards_of_bounded_size(spark):
    rng = np.random.default_rng(2)
    rows = make_rows(rng, 24, 500, 150, 60)
    nodes = vectordup.unit_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").selectExpr("key", "dims", "1L as weight", "vec")
    members = vectordup.cluster_shards(nodes, 100, 8, 3)
    sizes = [r["count"] for r in members.groupBy("shard").count().collect()]
    assert max(sizes) <= 100 and len(sizes) > 8                      # two levels
    assert members.select("key").distinct().count() == len(rows)
    out = vectordup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), limit=150)
    want, have = truth(rows), got(out)
    links, true = sum(r[1] for r in have), sum(r[1] for r in want)
    assert all(h[1] <= w[1] for h, w in zip(sorted(have, key=lambda r: r[0]), sorted(want, key=lambda r: r[0])))    # no false link
    assert links >= 0.98 * true and out.first().audited_recall >= 0.98


def test_graph_lists_are_pruned_and_reach():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 32)).astype(np.float32)
    x[350:450] = x[:100] + 0.3 * rng.normal(size=(100, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    adj = flatgraph.build(x)
    assert adj.shape == (700, flatgraph.DEGREE)
    for k, row in enumerate(adj):
        row = row[row >= 0]
        assert len(row) and k not in row and len(set(row.tolist())) == len(row)
    hit = flatgraph.search(x, adj, x, np.full((700, 1), flatgraph.medoid(x)), within=0.9)[2]
    cos = x @ x.T
    assert not (hit & (cos < 0.8999)).any()
    true = cos >= 0.9001
    assert ((hit | hit.T) & true).sum() >= 0.99 * true.sum()
    assert flatgraph.build(x[:1]).tolist() == [[-1] * flatgraph.DEGREE] and len(flatgraph.build(x[:0])) == 0


def test_low_dimensional_dense_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in np.float32(rng.normal(size=3))], 0) for k in range(220)]
    have, want = got(vectordup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA))), truth(rows)
    assert sum(r[1] for r in have) >= 0.99 * sum(r[1] for r in want)
