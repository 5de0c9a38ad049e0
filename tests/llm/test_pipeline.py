import random
from collections import Counter

import corpus_pipeline
from tessera.llm.queries import WEIGHTS

from .helpers import SF, clash, docs, odd_rows, sentence
from .test_decontaminate import brute as hits
from .test_decontaminate import windows
from .test_mixing_and_sharding import brute as mixture
from .test_neardup import brute as groups


def test_stages_follow_each_other(spark):
    """Each stage against its brute-force version on what the one before kept;
    no document of a known language is rejected."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = table.columns, table
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table.collect()]
    wins = windows([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns
        if name == "near_dedup":
            kept = {i for i, _, _, k in groups([(i, t) for i, t, *_ in rows]) if k}
            rows = [r for r in rows if repr(r[0]) in kept]
        elif name == "decontamination":
            rows = [r for r in rows if hits(r[1], wins)[1] == 0]
        elif name == "mixing":
            assert WEIGHTS
            kept = {i for i, _, _ in mixture(rows, corpus_pipeline.BUDGET, 1)}
            rows = [r for r in rows if repr(r[0]) in kept]
        now = spark.createDataFrame(now.collect(), table.schema)
        assert sorted(r.doc_id for r in now.collect()) == sorted(r[0] for r in rows), name
    shards = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sorted(r.doc_id for r in shards) == sorted(r[0] for r in rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)


def test_stages_take_odd_rows_and_extra_columns(spark):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    rows = [(None if i is None else i + 10_000, t) for i, t in odd_rows()]
    for extra in (False, True):
        now = docs(spark, base + rows)
        now = clash(now) if extra else now
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.count() > 0


def test_stages_take_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF).count() == 0


def test_sharding_keeps_sources_together(spark):
    """No two texts are equal after stage 2: the link must be another one.  Of
    20 equal sources on 8 shards a hash layout cuts 7 of 8 pairs."""
    rng = random.Random(8)
    rows = [(k, sentence(rng, 30), "en", f"src{k % 20}") for k in range(1200)]
    rows += [(5000 + k, sentence(rng, 30), "en", None if k % 2 else "") for k in range(100)]
    got = corpus_pipeline.STAGES[-1][1](spark, docs(spark, rows), SF).collect()
    sizes, held = Counter(), Counter()
    for r in got:
        sizes[r.shard] += r["size"]
        if r.doc_id < 5000:
            held[r.doc_id % 20, r.shard] += 1
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 8
    assert sum(n * n for n in held.values()) > 0.6 * 20 * 60 * 60      # ordered pairs of a source in one shard
