import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chunks, repeats
from tessera.llm.kernels import utf8

from .helpers import SF, clash, docs, odd_rows, sentence


def brute(rows, depth):
    """(bytes, removed, spans, kept digest) of each row from all windows."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for p in range(len(b) - depth + 1):
            seen[b[p:p + depth]] = seen.get(b[p:p + depth], 0) + 1
    out = []
    for (i, _), b in zip(rows, texts):
        gone = [False] * len(b)
        for p in range(len(b) - depth + 1):
            if seen[b[p:p + depth]] > 1:
                gone[p:p + depth] = [True] * depth
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((repr(i), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((repr(r.doc_id), r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                  for r in df.collect())


def fixture():
    rng = random.Random(9)
    shared = [sentence(rng, 12) for _ in range(4)]
    rows = list(odd_rows())
    for k in range(60):
        rows.append((100 + k, f"{sentence(rng, rng.randint(0, 25))} {rng.choice(shared)} {sentence(rng, rng.randint(0, 12))}"))
    return [*rows, (400, "ab" * 300), (401, "xyz" * 5 + "ab" * 90), (402, "0" * 41), (403, "0" * 40)]


def test_removed_bytes_equal_brute_force(spark):
    rows = fixture()
    assert result(repeats.remove_repeats(clash(docs(spark, rows)), depth=40, gram=8)) == brute(rows, 40)


def test_pieces_of_long_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    monkeypatch.setattr(repeats, "OUTPUT", 800)
    rows = fixture()
    for row, data in ((r, r[1].encode()) for r in rows if r[1] and len(r[1]) > 2000):
        off = np.array([0, len(data)])
        runs = repeats.window_runs(np.frombuffer(data, np.uint8), off, 40, 8)
        assert runs[4].sum() == len(data) - 39 and runs[3][0] == 0
    assert result(repeats.remove_repeats(docs(spark, rows), depth=40, gram=8)) == brute(rows, 40)


def test_a_passage_in_many_contexts(spark, monkeypatch):
    """One passage in 2,000 different texts: the bytes are the same, and a run
    costs some blocks a pass, not one row for each of its windows."""
    rng = random.Random(12)
    passage = sentence(rng, 45)
    rows = [(k, f"{sentence(rng, rng.randint(5, 25))} {passage} {sentence(rng, rng.randint(5, 25))}") for k in range(2000)] + odd_rows()
    blocks, once = [], repeats.tie

    def noted(some, depth):
        blocks.append((some.count(), some.agg(F.sum("n")).first()[0]))
        return once(some, depth)

    monkeypatch.setattr(repeats, "tie", noted)
    assert result(repeats.remove_repeats(docs(spark, rows))) == brute(rows, 200)
    assert len(blocks) == 4 and all(n < 5 * blocks[0][0] for n, _ in blocks) and max(n for n, _ in blocks[1:]) < blocks[0][1] / 4


def test_removal_on_empty_tables_and_bad_depths(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs(spark, []), depth=10, gram=10)


def test_repeats_query_against_brute_force(spark):
    from tessera.llm.queries import op5_repeats
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_repeats(spark, SF).collect())
    assert got == brute(rows, 200)


def plain_cuts(b, bits, least, most):
    """Chunk starts of one text, byte by byte."""
    h, last, starts, near = 0, 0, [0], -10**9
    ends, places = [], []
    for i, x in enumerate(b):
        h = sum(int(chunks._GEAR[b[i - j]]) << j for j in range(min(16, i + 1))) & 0xFFFF
        if i >= 15 and h >> (16 - bits) == 0:
            places.append(i + 1)
    for p in places:
        if p < len(b) and p - last >= least:
            starts.append(p)
            last = p
    out = []
    for a, z in zip(starts, [*starts[1:], len(b)]):
        out += list(range(a, z, most)) if z > a else []
    return out


def test_cuts_equal_a_byte_by_byte_walk():
    texts = [t for _, t in fixture()][:40]
    data, off = utf8(pa.array(texts))
    starts, at = chunks.cuts(data, off, 5, 16, 256)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert [int(s) - int(off[i]) for s in starts[at[i]:at[i + 1]]] == plain_cuts(b, 5, 16, 256), i


def test_chunks_behind_an_insertion_stay():
    rng = random.Random(1)
    one = sentence(rng, 600).encode()
    two = one[:900] + b"an inserted phrase " + one[900:]
    sets = []
    for b in (one, two):
        data, off = utf8(pa.array([b], pa.binary()))
        starts, _ = chunks.cuts(data, off, 5, 16, 256)
        sets.append(set(zip(*(d.tolist() for d in chunks.digests(data, starts)))))
    assert len(sets[0] - sets[1]) <= 4 and len(sets[0]) > 50


def test_chunk_dedup_keeps_first_and_is_lossless_elsewhere(spark):
    rng = random.Random(12)
    passage = sentence(rng, 60)
    rows = [(k, f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}") for k in range(1, 8)] + [(20, sentence(rng, 80))]
    rows += [(30, "short copy"), (31, "short copy"), *[r for r in odd_rows() if r[0] not in (6, 7, 8)]]
    got = {}
    for r in chunks.drop_repeated_chunks(clash(docs(spark, rows))).collect():
        got.setdefault(r.doc_id, r)
    texts = dict(reversed(rows))
    for i, r in got.items():
        b = (texts[i] or "").encode() if i is not None else None
        if b is not None:
            kept, last = b"", 0
            for s in r.spans:
                kept, last = kept + b[last:s.lo], s.hi
            assert r.kept == kept + b[last:] and r.n_bytes == len(b)
    assert not got[1].spans and not got[20].spans and not got[30].spans and got[31].kept == b""
    for k in range(2, 8):
        assert sum(s.hi - s.lo for s in got[k].spans) > len(passage) / 2
    assert got[1].n_repeated > len(passage) / 2


def test_chunk_query_is_whole_and_deterministic(spark):
    from tessera.llm.queries import op9_chunks
    one, two = ({tuple(r) for r in op9_chunks(spark, SF).collect()} for _ in range(2))
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert one == two and len(one) == n
    assert chunks.drop_repeated_chunks(docs(spark, [])).count() == 0
