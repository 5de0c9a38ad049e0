import hashlib
import random
import re

from tessera.llm import decontaminate as dc
from tessera.llm.kernels import ALNUM, SPACED, utf8, words

from .helpers import SF, clash, docs, lower_ascii, odd_rows, sentence

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(items, n=10):
    out = {}
    for item, text in items:
        w = W.findall(lower_ascii(text))
        k = min(n, len(w))
        if item is None or not w:
            continue
        for i in range(len(w) - k + 1):
            out.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    return out


def brute(text, wins):
    w = W.findall(lower_ascii(text))
    hit, items = [0] * len(w), set()
    for k in {len(x) for x in wins}:
        for i in range(len(w) - k + 1):
            if found := wins.get(tuple(w[i:i + k])):
                items |= found
                hit[i:i + k] = [1] * k
    return len(w), sum(hit), sorted(items)


def check(rows, items, spark, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.benchmark_matches(docs(spark, rows), bench, **options).collect()
    wins = windows(items)
    want = sorted((repr(i), *brute(t, wins)) for i, t in rows)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    return got


def fixture():
    rng = random.Random(2)
    items = [(k, sentence(rng, 5 + 7 * (k % 4))) for k in range(12)]
    items += [(20, items[3][1]), (21, items[1][1]), (None, sentence(rng, 12)), (22, None), (23, "..."), (24, "Lone")]
    rows = list(odd_rows())
    for k in range(60):
        t = sentence(rng, rng.randint(0, 40))
        item = (items[rng.randrange(12)][1]).split()
        a = rng.randint(0, 3)
        rows.append((100 + k, f"{t} {' '.join(item[a:]).upper()}, {sentence(rng, 6)}"))
    rows.append((300, "a lone word"))
    return rows, items


def test_matches_equal_brute_force(spark):
    rows, items = fixture()
    check(rows, items, spark)


def test_blocks_of_the_benchmark_and_small_shards(spark, monkeypatch):
    rows, items = fixture()
    monkeypatch.setattr(dc, "SHARD_WORDS", 50)
    check(rows, items, spark, block_bytes=60)


def test_passes_over_a_large_benchmark_equal_one_pass(spark):
    rows, items = fixture()
    rng = random.Random(9)
    a, b = sentence(rng, 14), sentence(rng, 14)
    items += [(40, a), (41, " ".join(a.split()[4:] + b.split()[:6])), (42, b)]      # overlapping hits of three passes
    rows += [(400, f"x {a} {b} y"), (401, f"{b} {a}")]
    one = check(rows, items, spark)
    several = check(rows, items, spark, pass_bytes=200)
    assert sorted(map(repr, one)) == sorted(map(repr, several))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(dc.test_passes(bench, "item_id", "text", 10, 1 << 20, 200))) > 3
    table = clash(docs(spark, rows))
    kept = dc.decontaminate(table, bench, pass_bytes=400)
    assert kept.schema == table.schema
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, dc.decontaminate(table, bench).collect()))


def test_runs_of_two_passes_are_united():
    assert dc.united([], [1, 3]) == [1, 3] and dc.united([0, 2, 5, 9], [2, 4, 6, 12, 20, 21]) == [0, 4, 5, 12, 20, 21]


def test_longest_match_and_its_place(spark):
    rng = random.Random(8)
    item = sentence(rng, 30)
    rows = [(1, f"{sentence(rng, 7)} {' '.join(item.split()[4:25])} end"), (2, sentence(rng, 9))]
    got = {r.doc_id: r for r in check(rows, [(5, item)], spark)}
    assert (got[1].longest_match, got[1].longest_at, got[1].longest_item) == (21, 7, "5")
    assert (got[2].longest_match, got[2].longest_at) == (0, None)


def test_removal_keeps_columns_and_clean_rows(spark):
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = clash(docs(spark, rows))
    kept = dc.decontaminate(table, bench)
    assert kept.schema == table.schema
    wins = windows(items)
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(i) for i, t in rows if brute(t, wins)[1] == 0)


def test_empty_tables(spark):
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.benchmark_matches(docs(spark, []), bench).count() == 0
    none = dc.benchmark_matches(docs(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and all(r.n_hit == 0 and r["items"] == [] for r in none)


def test_query_against_brute_force(spark):
    from tessera.llm.queries import op3_decontaminate
    wins = windows([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op3_decontaminate(spark, SF).collect():
        n, hit, items = brute(texts[r.doc_id], wins)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_words_agree_with_the_patterns():
    import pyarrow as pa
    texts = ["", "Aa-bB é1\x00z\x7fq", None, "x" * 50, "\x0b a\tb\x1cc d", "ABC abc"]
    data, off = utf8(pa.array(texts))
    for table, pattern in ((ALNUM, W), (SPACED, re.compile(r"[^\x20\x09-\x0D]+"))):
        h, woff, s, e = words(data, off, table, spans=True)
        found = [w for t in texts for w in pattern.findall(lower_ascii(t))]
        assert [lower_ascii(bytes(data[a:z]).decode()) for a, z in zip(s, e)] == found
        assert woff.tolist() == [sum(len(pattern.findall(lower_ascii(t))) for t in texts[:k]) for k in range(len(texts) + 1)]
        assert len(set(h.tolist())) == len(set(found))
