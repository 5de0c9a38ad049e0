import random
import re

import pytest

from tessera.llm import neardup
from tessera.llm.components import connected_components

from .helpers import SF, clash, docs, lower_ascii, odd_rows, sentence, word

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = W.findall(lower_ascii(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(set size, component) of each id by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is None or b is None:
                continue
            both = len(s & t)
            if both and 100 * both >= 75 * len(s | t):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((repr(i), len(s), repr(None if i is None else top(i)), i is None or top(i) == i) for i, s in sets)


def near_group(rng, first, n, words=60, edits=6):
    """Copies of one base text, each with its own edits: all meet in buckets,
    many pairs lie a little under or over the threshold."""
    base = sentence(rng, words).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = word(rng)
        out.append((first + k, " ".join(w)))
    return out


def result(df):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in df.collect())


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [r for r in odd_rows() if r[0] != 8] + near_group(rng, 1000, 60) + near_group(rng, 100, 20, words=12, edits=1)
    rows += [(2000 + k, rows[20][1]) for k in range(30)]
    rows += [(3000 + k, sentence(rng, rng.randint(1, 30))) for k in range(40)]
    rng.shuffle(rows)
    assert result(neardup.near_duplicates(clash(docs(spark, rows)))) == brute(rows)


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "SALT", 5)
    rows = near_group(random.Random(4), 1, 80)
    assert result(neardup.near_duplicates(docs(spark, rows))) == brute(rows)


def test_rows_that_share_an_id(spark):
    rng = random.Random(6)
    a, b = sentence(rng, 20), sentence(rng, 20)
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b), (12, None)]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (12, 12)}


def test_drop_keeps_one_of_each_group_and_the_columns(spark):
    rng = random.Random(7)
    rows = [r for r in odd_rows() if r[0] != 8] + near_group(rng, 100, 12, edits=1)
    table = clash(docs(spark, rows))
    kept = neardup.drop_near_duplicates(table)
    assert kept.schema.names == table.schema.names
    want = sorted(i for i, _, _, k in brute(rows) if k)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want


def test_empty_table(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert neardup.near_duplicates(docs(spark, [(1, None), (2, "")])).where("not kept").count() == 0


def test_query_against_brute_force(spark):
    from tessera.llm.queries import op4_near_duplicates
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(op4_near_duplicates(spark, SF)) == brute(rows)


def test_least_matches_follow_the_posterior():
    need = neardup.least_matches(128, 16, 0.75, 1e-6)
    assert need == sorted(need) and 0 <= need[0] < 8 and 60 < need[-1] < 96
    assert all(a >= b for a, b in zip(neardup.least_matches(128, 16, 0.75, 1e-2), need))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(20)] + [(None, 3)]
    up = {x: x for e in edges if None not in e for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            if a is not None:
                up[a] = up[b] = min(up[a], up[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    want = {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in got.collect()} == want
