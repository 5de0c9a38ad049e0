"""Text analytics over a table of documents.

Whole texts are read (``max_chars`` is for callers that want a cut).  Words and
sentences are counted text by text (``functions.terms``) where the text is: nothing
is shuffled.  Word frequencies are those of an id: rows that share one, or have
none, are one text, and only these are hash-partitioned by their id, once; every
later group/window keyed by (id, ...) reuses that.  Summaries and reports work by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults
from ..functions.numeric import round_half_up
from ..functions.terms import TERM_TOKEN, WORD_TOKEN, summary, weight_rows
from ..functions.text import split_sentences, truncate_chars, word_count
from ..session import scratch_path, text_batches

#: Repeated ids that are broadcast at most.
MAX_REPEATED = 1_000_000


def word_counts(df: DataFrame, id_col: str, text_col: str = "text",
                max_chars: int | None = None) -> DataFrame:
    """A01 (full text) / A02 (first ``max_chars`` characters)."""
    t = F.col(text_col) if max_chars is None else truncate_chars(text_col, max_chars)
    return df.select(id_col, word_count(t).alias("word_count"))


def by_document(df: DataFrame, id_col: str, text_col: str, max_chars: int | None,
                partitioned: bool = False, *more: str) -> DataFrame:
    """(id, t, more...), hash-partitioned by id (skipped when the caller already
    partitioned ``df`` by id)."""
    t = F.col(text_col) if max_chars is None else truncate_chars(text_col, max_chars)
    out = df.select(F.col(id_col), t.alias("t"), *more)
    return out if partitioned else out.repartition(id_col)


def _fold(forms: DataFrame, part: list[str], key: str, spelling: str, count: str) -> DataFrame:
    """Plural folding over (part..., key, spelling, count) rows: a key ending in
    's' (not 'ss') merges into key[:-1] when that key occurs in the same
    ``part`` group, its spellings losing their last character.  Returns
    (part..., key, fk, spelling2, count); the stem window is keyed by
    (part..., stem), so it runs inside the document partitioning."""
    k = F.col(key)
    stem = F.when(k.endswith("s") & ~k.endswith("ss"), F.expr(f"substring({key}, 1, length({key}) - 1)")).otherwise(k)
    f = forms.withColumn("_stem", stem)
    has_sing = F.max((F.col(key) == F.col("_stem")).cast("int")).over(Window.partitionBy(*part, "_stem")) == 1
    f = f.withColumn("_has_sing", has_sing)
    fk = F.when(F.col("_has_sing"), F.col("_stem")).otherwise(F.col(key))
    sp = (F.when(F.col(key) == F.col("_stem"), F.col(spelling))
          .when(F.col("_has_sing"), F.expr(f"substring({spelling}, 1, length({spelling}) - 1)"))
          .otherwise(F.col(spelling)))
    return f.select(*part, key, fk.alias("fk"), sp.alias("spelling2"), count)


def _groups(folded: DataFrame, part: list[str], count: str) -> DataFrame:
    """(part..., fk, n, term, keys): total count per folded key, its most
    frequent spelling (ties -> the larger string) and the keys folded into it."""
    per_spelling = folded.groupBy(*part, "fk", "spelling2").agg(
        F.sum(count).alias("_c"), F.collect_set("key").alias("_keys"))
    return per_spelling.groupBy(*part, "fk").agg(
        F.sum("_c").alias("n"),
        F.max(F.struct(F.col("_c").alias("c"), F.col("spelling2").alias("s")))["s"].alias("term"),
        F.array_distinct(F.flatten(F.collect_list("_keys"))).alias("keys"))


def _llr(k, n, x):
    """Dunning's log-likelihood term k*ln(x) + (n-k)*ln(1-x), guarded at 1e-10."""
    return k * F.log(F.greatest(x, F.lit(1e-10))) + (n - k) * F.log(F.greatest(F.lit(1.0) - x, F.lit(1e-10)))


def collocation_score(c12, c1, c2, n):
    """-2 log lambda for a bigram (Dunning 1993; Manning & Schuetze 5.3.4)."""
    p = c2 / n
    p1 = c12 / c1
    p2 = F.when(n - c1 > 0, (c2 - c12) / (n - c1)).otherwise(F.lit(0.0))
    return F.lit(-2.0) * (_llr(c12, c1, p) + _llr(c2 - c12, n - c1, p) - _llr(c12, c1, p1) - _llr(c2 - c12, n - c1, p2))


def _told_apart(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows with an id of their own, the others or None): the ids that come more
    than once are written as a table; without any, nothing is joined."""
    path = scratch_path(df.sparkSession, "repeated-ids")
    df.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).select(F.col(id_col).alias("_again")).write.parquet(path)
    again = df.sparkSession.read.parquet(path)
    n = again.count()
    if not n:
        return df, None
    again = F.broadcast(again) if n <= MAX_REPEATED else again
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def word_frequencies(df: DataFrame, id_col: str, text_col: str = "text",
                     max_chars: int | None = None, stop_words: DataFrame | None = None,
                     max_words: int | None = None,
                     collocations: bool = False, threshold: float = defaults.COLLOCATION_THRESHOLD) -> DataFrame:
    """A12 + L06: word-cloud term weights per document.

    Words of two or more characters; a trailing "'s" removed; pure numbers
    removed; stop words (any case) dropped; a plural merged into its singular
    when both occur (display form = most frequent spelling, plural spellings
    counted without their 's'); with ``collocations``, neighbouring non-stop
    word pairs whose log-likelihood score exceeds ``threshold`` become terms
    and their count is taken off both words (words left with no count
    disappear).  weight = count / max count; rank by (count desc, term), and
    with ``max_words`` only so many.  Returns (id, term, n, weight, rank).

    Plan: a row with an id of its own is weighed where it is, without a shuffle.
    Rows that share an id, or have none, and those that meet a caller's table of
    stop words go through ``_shared_frequencies``."""
    rows, shared = (None, df) if stop_words is not None else _told_apart(df, id_col)
    found = [] if shared is None else [_shared_frequencies(shared, id_col, text_col, max_chars, stop_words, max_words, collocations, threshold)]
    if rows is not None:
        text_batches(df.sparkSession)
        t = F.col(text_col) if max_chars is None else truncate_chars(text_col, max_chars)
        kind = df.schema[id_col].dataType.simpleString()
        found.append(rows.select(id_col, F.make_valid_utf8(t).alias("t")).mapInArrow(
            lambda batches: weight_rows(batches, collocations, threshold, max_words),
            f"`{id_col}` {kind}, term string, n long, weight double, rank long"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _shared_frequencies(df: DataFrame, id_col: str, text_col: str, max_chars: int | None, stop_words: DataFrame | None,
                        max_words: int | None, collocations: bool, threshold: float) -> DataFrame:
    """``word_frequencies`` of ids with any number of rows, which are one text.

    Plan: unigram and bigram rows share one grouping inside the document
    partitioning; with collocations the grouped table (bounded per document)
    is checkpointed once and every later step (dictionaries, scores, count
    adjustments, ranking) reads it - no joins on keys other than the id."""
    spark = df.sparkSession
    sw = stop_words if stop_words is not None else defaults.stop_words_df(spark)
    sw = sw.select(F.lower("word").alias("key")).distinct() if stop_words is not None else \
        sw.select(F.col("word").alias("key"))  # built-in list is unique
    sw = F.broadcast(sw.withColumn("_stop", F.lit(True)))
    docs = by_document(df, id_col, text_col, max_chars)
    toks = docs.select(id_col, F.posexplode(F.regexp_extract_all("t", F.lit(WORD_TOKEN), F.lit(0))).alias("pos", "w"))
    toks = toks.withColumn("w", F.when(F.lower("w").endswith("'s"),
                                       F.expr("substring(w, 1, length(w) - 2)")).otherwise(F.col("w")))
    toks = toks.where(~F.col("w").rlike(r"^\p{N}+$")).withColumn("key", F.lower("w"))
    toks = toks.join(sw, "key", "left").withColumn("stop", F.coalesce(F.col("_stop"), F.lit(False))).drop("_stop")
    grams = toks.where(~F.col("stop")).select(id_col, F.lit(1).alias("kind"), "key", "w")
    if collocations:
        wpos = Window.partitionBy(id_col).orderBy("pos")
        pairs = toks.select(id_col, "w", "key", "stop", F.lead("w").over(wpos).alias("w2"),
                            F.lead("key").over(wpos).alias("key2"), F.lead("stop").over(wpos).alias("stop2"))
        pairs = pairs.where(F.col("key2").isNotNull() & ~F.col("stop") & ~F.col("stop2")).select(
            id_col, F.lit(2).alias("kind"), F.concat_ws(" ", "key", "key2").alias("key"),
            F.concat_ws(" ", "w", "w2").alias("w"))
        grams = grams.unionByName(pairs)
    forms = grams.groupBy(id_col, "kind", "key", "w").agg(F.count("*").alias("c"))
    part = [id_col, "kind"]
    groups = _groups(_fold(forms, part, "key", "w", "c"), part, "c")
    if collocations:
        # five consumers read the grouped grams: write them once to the shared
        # checkpoint directory (reliable checkpoint, survives executor loss)
        # instead of recomputing the token pipeline for each
        from ..session import shared_root
        shared_root(spark)
        groups = groups.checkpoint(eager=True)
    uni = groups.where(F.col("kind") == 1)
    terms = uni.select(id_col, "fk", "term", "n")
    if collocations:
        # (id, key) -> folded key and (id, folded key) -> count, as joins inside
        # the document partitioning: a document's words are never one map
        folded = uni.select(id_col, F.explode("keys").alias("k"), "fk", F.col("n").alias("c"))
        total = uni.groupBy(id_col).agg(F.sum("n").alias("n_words"))
        parts = F.split(F.lower(F.col("term")), " ")
        b = (groups.where(F.col("kind") == 2).withColumn("k1", F.get(parts, F.lit(0))).withColumn("k2", F.get(parts, F.lit(1)))
             .join(total, id_col))
        for i in ("1", "2"):
            b = b.join(folded.select(id_col, F.col("k").alias(f"k{i}"), F.col("fk").alias(f"fk{i}"), F.col("c").alias(f"c{i}")),
                       [id_col, f"k{i}"], "left")
        c1, c2 = F.col("c1").cast("double"), F.col("c2").cast("double")
        score = collocation_score(F.col("n").cast("double"), c1, c2, F.col("n_words").cast("double"))
        coll = b.where(score > threshold).select(id_col, "fk1", "fk2", "term", "n")
        # count adjustments as a union + aggregate per (id, folded key): no join
        minus = coll.select(id_col, F.inline(F.array(
            F.struct(F.col("fk1").alias("fk"), F.lit(None).cast("string").alias("term"), (-F.col("n")).alias("n")),
            F.struct(F.col("fk2").alias("fk"), F.lit(None).cast("string").alias("term"), (-F.col("n")).alias("n")))))
        adjusted = (terms.unionByName(minus).groupBy(id_col, "fk")
                    .agg(F.max("term").alias("term"), F.sum("n").alias("n"))
                    .where((F.col("n") > 0) & F.col("term").isNotNull()))
        terms = adjusted.select(id_col, "term", "n").unionByName(coll.select(id_col, "term", "n"))
    else:
        terms = terms.select(id_col, "term", "n")
    w_rank = Window.partitionBy(id_col).orderBy(F.desc("n"), F.asc("term"))
    w_all = Window.partitionBy(id_col)
    ranked = terms.withColumn("rank", F.row_number().over(w_rank).cast("long"))
    out = ((ranked if max_words is None else ranked.where(F.col("rank") <= max_words))
           .withColumn("weight", round_half_up(F.col("n") / F.max("n").over(w_all), 6)))
    return out.select(id_col, "term", F.col("n").cast("long").alias("n"), "weight", "rank")


def top_terms(freqs: DataFrame, id_col: str, k: int = defaults.WORDCLOUD_MAX_WORDS) -> DataFrame:
    """(id, top_terms): the ``k`` heaviest terms of each document, in order."""
    return freqs.where(F.col("rank") <= k).groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_terms"))


def corpus_top_terms(freqs: DataFrame, k: int = defaults.WORDCLOUD_MAX_WORDS) -> DataFrame:
    """L06 over a corpus: the ``k`` heaviest terms by total count (ties by term).

    A global top-k: Spark plans ``orderBy().limit()`` as TakeOrderedAndProject,
    which keeps only k rows per task before the final merge."""
    return (freqs.groupBy(F.lower("term").alias("term")).agg(F.sum("n").cast("long").alias("n"))
            .orderBy(F.desc("n"), F.asc("term")).limit(k))


def sentence_table(df: DataFrame, id_col: str, text_col: str = "text",
                   max_chars: int | None = None, partitioned: bool = False, *more: str) -> DataFrame:
    """(id, more..., pos, sentence) for every non-empty '.'-separated sentence."""
    docs = by_document(df, id_col, text_col, max_chars, partitioned, *more)
    s = docs.select(id_col, *more, F.posexplode(split_sentences("t")).alias("pos", "sentence"))
    return s.where(F.col("sentence") != "").withColumn("pos", F.col("pos").cast("long"))


def extractive_summary(df: DataFrame, id_col: str, text_col: str = "text",
                       max_chars: int | None = None,
                       budget: int | str = defaults.SUMMARY_TOKEN_BUDGET,
                       stop_words: DataFrame | None = None) -> DataFrame:
    """Frequency-based extractive summary (SumBasic-style).

    Sentences are scored by the mean
    in-document frequency of their non-stop words; best sentences (ties by
    position) are taken while the running word count stays within
    ``budget`` (words, or a column of them; always at least one sentence) and
    printed in original order.
    Returns (id, summary, n_sentences), one row per row of ``df`` that holds a
    sentence, whatever its id.

    Plan: sentences are scored and chosen where the text is; nothing moves.  A
    caller's table of stop words comes to the rows as one broadcast set."""
    text_batches(df.sparkSession)
    rows, stops = df, None
    if stop_words is not None:
        rows = df.crossJoin(F.broadcast(stop_words.agg(F.collect_set(F.lower("word")).alias("_stops"))))
        stops = F.col("_stops")
    t = F.col(text_col) if max_chars is None else truncate_chars(text_col, max_chars)
    found = summary(t, F.col(budget) if isinstance(budget, str) else F.lit(budget), stops)
    return rows.select(F.col(id_col), found.alias("_s")).where("_s is not null").select(id_col, "_s.*")
