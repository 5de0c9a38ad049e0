"""Driver contract, a sample of oracle checks at sf0.001, and plan-shape checks."""

import duckdb

import __spark_entry__ as entry
from tessera import catalog
from tessera.operators.sentiment import sentiment_scores
from tessera.operators.retrieval import bm25_top1, keyword_match
from tessera import defaults

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert {"page_id", "title", "headings", "paragraphs", "links", "word_count", "summary", "sentiment"} <= set(df.columns)


def test_every_query_has_an_oracle():
    """Of the catalog; what the other package has no SQL for is tested against
    brute force there."""
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return v


def test_sample_of_oracles_at_small_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    qs, sql = entry.queries(), entry.oracle_sql()
    for name in ["page_report", "describe_numeric", "fact_answer", "qa_pairs", "word_frequencies",
                 "histogram", "extractive_summary", "tokenize_pad"]:
        got = qs[name](spark, SF).toPandas()
        want = con.sql(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        a = sorted(tuple(str(_norm(r[c])) for c in cols) for r in got.to_dict("records"))
        b = sorted(tuple(str(_norm(r[c])) for c in cols) for r in want.to_dict("records"))
        assert a == b, name


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentiment_is_worked_out_in_the_row(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = _plan(sentiment_scores(d, "doc_id"))
    assert "Window" not in plan and "Python" not in plan
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan


def test_keyword_match_has_no_nested_loop(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "explode(split(text, '\\\\.')) as s")
    kws = defaults.keywords_df(spark)
    assert "NestedLoopJoin" not in _plan(keyword_match(d, "s", kws))


def test_bm25_scores_stay_in_blocks(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = _plan(bm25_top1(b, "item_id", "text", d, "doc_id", "text"))
    assert "CoGroupsInArrow" in plan and "hashpartitioning(block" in plan    # blocks of documents meet batches of queries
    assert "hashpartitioning(term" not in plan and "hashpartitioning(qid#0, doc" not in plan
