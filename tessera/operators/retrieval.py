"""Question answering over tables.

Dictionary lookups become broadcast equi-joins, search becomes BM25 over a
corpus table, and the answer cascade is a ``coalesce`` chain with a
``source`` column naming the tier that answered.

BM25 keeps exact scores without pairs: postings stand in blocks of documents,
and each (block, batch of queries) group finds every query's best document by
block-max bounds (see ``bm25_top1``).  The best of all blocks is a
``min(struct(-score, doc))`` aggregate, partial per task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import defaults
from ..functions.numeric import round_half_up
from ..functions.text import (any_of, clean_response, contains_any, drop_question_marks, first_line,
                              normalize_question, split_sentences, truncate_chars)
from ..session import scratch_path, ship_package, text_batches
from .blockmax import best_by, count_terms, token_slices
from .sentiment import checked_broadcast
from .text import TERM_TOKEN

MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 1_000_000, 32 << 20
#: Postings of a block and query terms of a batch: together the memory of a group.
BLOCK_POSTINGS, BATCH_TERMS = 4_000_000, 4_000_000
#: Partitions above which groups may share one.
MAX_PARTS = 1000
#: Tokens of rows that are counted together.
BATCH_TOKENS = 500_000
ROW = -1        # number of the term that stands for a row of the corpus


def terms(c: Column) -> Column:
    """Lower-cased letter/digit runs (array, with repeats)."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM_TOKEN), F.lit(0))


def alias_lookup(questions: DataFrame, q_col: str = "question", aliases: DataFrame | None = None) -> DataFrame:
    """J01 + F01: adds ``search_query`` = alias title of lower(question) if
    known, else the question without '?'."""
    spark = questions.sparkSession
    al = aliases if aliases is not None else defaults.aliases_df(spark)
    al = checked_broadcast(al.select(F.col("alias").alias("_key"), F.col("title").alias("_title")),
                           MAX_BROADCAST_ROWS, known_max=None if aliases is not None else len(defaults.ALIASES))
    out = questions.withColumn("_key", normalize_question(q_col)).join(al, "_key", "left")
    return out.withColumn("search_query", F.coalesce(F.col("_title"), drop_question_marks(q_col))).drop("_key", "_title")


def canned_answer(df: DataFrame, query_col: str = "search_query", canned: DataFrame | None = None) -> DataFrame:
    """Adds ``canned`` = the stored answer of lower(search_query) or null."""
    spark = df.sparkSession
    ca = canned if canned is not None else defaults.canned_df(spark)
    ca = checked_broadcast(ca.select(F.col("question").alias("_ck"), F.col("answer").alias("canned")),
                           MAX_BROADCAST_ROWS, known_max=None if canned is not None else len(defaults.CANNED_ANSWERS))
    return df.withColumn("_ck", F.lower(query_col)).join(ca, "_ck", "left").drop("_ck")


GRAM = 3


def keyword_match(sentences: DataFrame, text_col: str, keywords: DataFrame | list[str], whole_word: bool = False) -> DataFrame:
    """Sentences containing any keyword (lower-cased) as a substring, or
    with ``whole_word`` between other signs than letters, digits and '_'.

    A list is one regular expression.  A table (of any size) is an equi-join:
    each distinct sentence goes out with its character runs of up to ``GRAM``,
    meets the keywords that begin so, and ``contains`` decides; the sentences
    found come back by a semi-join."""
    s = F.lower(F.col(text_col))
    if not isinstance(keywords, DataFrame):
        kws = {k.lower() for k in keywords}
        if whole_word:
            return sentences.where(s.rlike(r"(?:^|[^\p{L}\p{N}_])" + any_of(kws - {""}) + r"(?:$|[^\p{L}\p{N}_])"))
        return sentences.where(contains_any(s, kws))
    kw = (keywords.select(F.lower("keyword").alias("_kw")).where("_kw is not null").distinct()
          .withColumn("_gram", F.substring("_kw", 1, GRAM)))
    at = F.sequence(F.lit(1), F.greatest(F.length("_t"), F.lit(1)))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_runs(at, k) for k in range(1, GRAM + 1)]))
    texts = sentences.select(s.alias("_t")).where("_t is not null").distinct()
    met = texts.select("_t", F.explode(grams).alias("_gram")).join(kw, "_gram")
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])\Q"), F.col("_kw"), F.lit(r"\E($|[^\p{L}\p{N}_])"))
    found = met.where(F.regexp("_t", pattern) if whole_word else F.contains("_t", F.col("_kw"))).select("_t").distinct()
    return sentences.join(found, s == F.col("_t"), "left_semi")


def _runs(at: Column, k: int) -> Column:
    return F.transform(at, lambda i: F.substring(F.col("_t"), i, F.lit(k)))


def bm25_top1(queries: DataFrame, q_id: str, q_text: str, corpus: DataFrame, d_id: str, d_text: str,
              k1: float = 1.2, b: float = 0.75, block_postings: int = BLOCK_POSTINGS, batch_terms: int = BATCH_TERMS,
              return_bound: bool = False):
    """J05 + L03: best document per query by BM25 (ties -> smaller doc id).

    Returns (q_id, doc_id, score) for queries with at least one matching term;
    score = sum over distinct query terms of
    ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)),
    rounded to 6 decimals before ranking.  Rows of the corpus that share an id are
    one document; those without an id count in N and avgdl, but cannot be found.

    Plan: the query terms get numbers, and the only pass over the corpus counts them
    in each row (``_counted``).  The lists of counts are dealt by document into blocks
    of about ``block_postings``, queries into batches of about
    ``batch_terms`` terms; each (block, batch) is one group that finds every query's
    best document by block-max bounds (``blockmax``).  Between groups travel one
    row for each query and block, never (query, document) pairs."""
    spark = queries.sparkSession
    q_type, d_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, q_id), (corpus, d_id)))
    empty = spark.createDataFrame([], f"{q_id} {q_type}, doc_id {d_type}, score double")
    asked = _written(queries.select(F.col(q_id).alias("qid"), F.array_distinct(terms(F.col(q_text))).alias("_toks")), "queries")
    qt = asked.select("qid", F.explode("_toks").alias("term"))
    n_asked = asked.where(F.size("_toks") > 0).agg(F.count("*").alias("queries"), F.sum(F.size("_toks")).alias("terms")).first()
    if not n_asked.queries:
        return (empty, 0) if return_bound else empty
    words, size = _numbered(qt.select("term").distinct())
    small = size.n <= MAX_BROADCAST_ROWS and size.bytes <= MAX_BROADCAST_BYTES
    words = F.broadcast(words) if small else words
    docs = corpus.select(F.col(d_id).alias("doc"), terms(F.col(d_text)).alias("_toks"))
    counts = _written(_counted(docs, words, d_type) if small else _counted_by_join(docs, words), "counts")
    of_id = counts.groupBy("doc", "dl").agg(F.sum("n_rows").alias("rows"), F.count("*").alias("parts"))
    stats = of_id.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.sum(F.col("dl") * F.col("rows")).alias("words"),
                      F.sum(F.when(F.col("dl").isNotNull(), F.col("rows"))).alias("known"),
                      F.max(F.when(F.col("doc").isNotNull(), F.col("parts"))).alias("parts")).first()
    n_docs, avgdl = int(stats["n"]), (stats["words"] or 0) / (stats["known"] or 1)
    if not (n_docs and avgdl):
        return (empty, 0) if return_bound else empty
    counts = counts.where("doc is not null and size(t) > 0").select("doc", "dl", "t", "tf")
    if (stats["parts"] or 0) > 1:
        # rows of one id and length are counted together
        again = of_id.where("doc is not null and parts > 1").select("doc", "dl")
        whole = _listed(counts.join(again, ["doc", "dl"], "left_semi")
                        .select("doc", "dl", F.explode(F.arrays_zip("t", "tf")).alias("x"))
                        .groupBy("doc", "dl", F.col("x.t").alias("t")).agg(F.sum("x.tf").alias("tf")), "doc", "dl")
        counts = _written(counts.join(again, ["doc", "dl"], "left_anti").unionByName(whole), "counts")
    # a document of an unusual term is counted once for each of its lengths, as its postings are
    dfreq = _written(counts.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")), "document-counts")
    total = dfreq.agg(F.sum("df").alias("n")).first().n
    if not total:
        return (empty, 0) if return_bound else empty
    blocks = max(spark.sparkContext.defaultParallelism if total > block_postings // 8 else 1, -(-total // block_postings))
    batches = -(-n_asked.terms // batch_terms)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int")).withColumn("batch", every(batches))
    known = words.join(F.broadcast(dfreq) if small else dfreq, "t")             # at most a row for each query term
    sets = (qt.join(F.broadcast(known) if small else known, "term").groupBy("qid")
            .agg(F.collect_set(F.struct("t", "df")).alias("terms"))
            .select(F.pmod(F.xxhash64("qid"), F.lit(batches)).cast("int").alias("batch"), "qid",
                    F.col("terms.t").alias("t"), F.col("terms.df").alias("df")).withColumn("block", every(blocks)))
    # each group is long work on few bytes: partitions enough that hardly two groups meet, which are not put together again
    n = min(4 * blocks * batches, max(blocks * batches, MAX_PARTS))
    dealt, sets = (df.repartition(n, "block", "batch") for df in (dealt, sets))
    scored = (dealt.groupBy("block", "batch").cogroup(sets.groupBy("block", "batch"))
              .applyInArrow(best_by(n_docs, avgdl, k1, b), f"qid {q_type}, doc {d_type}, score double")
              .withColumn("score", round_half_up("score", 6)))
    best = scored.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("doc").alias("doc"))).alias("m"))
    hits = best.select(F.col("qid").alias(q_id), F.col("m.doc").alias("doc_id"), (-F.col("m.neg")).alias("score"))
    # at most one hit per query with a term
    return (hits, n_asked.queries) if return_bound else hits


def _numbered(words: DataFrame) -> tuple[DataFrame, Row]:
    """(term, t) of distinct terms, numbered from 0 without gaps, and (n, bytes) of them."""
    words = _written(words.withColumn("t", F.monotonically_increasing_id()), "query-terms")
    part = F.shiftright("t", 33).cast("int")
    parts = words.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).collect()
    held = dict((r.part, r.n) for r in parts)
    starts = [0, *accumulate(held.get(k, 0) for k in range(max(held) + 1))]
    number = F.element_at(F.lit(starts), part + 1) + F.col("t").bitwiseAND(F.lit((1 << 33) - 1))
    return (words.select("term", number.cast("int" if starts[-1] < 1 << 31 else "bigint").alias("t")),
            Row(n=starts[-1], bytes=sum(r.bytes for r in parts)))


def _counted(docs: DataFrame, words: DataFrame, d_type: str) -> DataFrame:
    """(doc, dl, n_rows, t, tf) of each row (doc, _toks): its number of tokens, and the
    numbers and counts of those in ``words``, which the Python workers hold."""
    spark = docs.sparkSession
    text_batches(spark)
    known = words.toArrow()
    held = spark.sparkContext.broadcast((known.column("term").combine_chunks(), known.column("t").to_numpy()))
    least = max(BATCH_TOKENS, 2 * len(known))       # a look at the words costs as much as so many tokens

    def run(batches):
        for rows in token_slices(batches, least):
            yield from count_terms(rows, *held.value).to_batches()

    return docs.mapInArrow(run, f"doc {d_type}, dl int, n_rows long, t array<{words.schema['t'].dataType.simpleString()}>, tf array<int>")


def _counted_by_join(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``_counted`` for words of any number; rows of one id and length are one here."""
    row = F.array(F.lit(""))     # no token is empty: an empty one stands for a row of the corpus
    found = F.when(F.col("doc").isNull() | F.col("_toks").isNull(), row).otherwise(F.concat("_toks", row))
    words = words.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(ROW).cast(words.schema["t"].dataType).alias("t")))
    tokens = docs.select("doc", F.size("_toks").alias("dl"), F.explode(found).alias("term")).join(words, "term")
    counts = tokens.groupBy("doc", "dl", "t").agg(F.count("*").alias("tf"))
    return _listed(counts, "doc", "dl", n_rows=F.sum(F.when(F.col("t") == ROW, F.col("tf"))))


def _listed(df: DataFrame, *key: str, **more: Column) -> DataFrame:
    """(key..., more..., t, tf) of rows (key..., t, tf) as lists, without ``ROW``."""
    one = F.when(F.col("t") != ROW, F.struct("t", F.col("tf").cast("int").alias("tf")))       # a null is not collected
    return (df.groupBy(*key).agg(*(c.alias(k) for k, c in more.items()), F.collect_list(one).alias("_l"))
            .select(*key, *more, F.col("_l.t").alias("t"), F.col("_l.tf").alias("tf")))


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table of its own below the shared folder, read back."""
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def relevant_sentences(summary: Column, keywords=None) -> Column:
    """Every '.'-sentence (stripped) holding a keyword, joined by ' ';
    null when none matches."""
    kws = [k for k in (defaults.FACT_KEYWORDS if keywords is None else keywords)]
    picked = F.filter(split_sentences(summary), lambda s: contains_any(F.lower(s), kws))
    return F.when(F.size(picked) > 0, F.array_join(picked, " "))


def first_matching_sentence(summary: Column, keywords=None) -> Column:
    """First '.'-sentence (stripped) holding a keyword; null when none."""
    kws = defaults.CORRECTION_KEYWORDS if keywords is None else keywords
    picked = F.filter(split_sentences(summary), lambda s: contains_any(F.lower(s), kws))
    return F.try_element_at(picked, F.lit(1))


def _search(df: DataFrame, corpus: DataFrame, d_id: str, d_text: str) -> DataFrame:
    """Top-1 document text per row of ``df`` (keyed by ``_rid``) for ``search_query``."""
    hits, bound = bm25_top1(df, "_rid", "search_query", corpus, d_id, d_text, return_bound=True)
    texts = corpus.select(F.col(d_id).alias("doc_id"), F.col(d_text).alias("summary"))
    # the hits (bounded by the counted query terms) are broadcast so the corpus
    # texts are read in place instead of being shuffled to meet them
    return texts.join(checked_broadcast(hits, MAX_BROADCAST_ROWS, known_max=bound), "doc_id")


def fact_answer(questions: DataFrame, q_id: str, q_col: str, corpus: DataFrame, d_id: str = "doc_id",
                d_text: str = "text", aliases: DataFrame | None = None, canned: DataFrame | None = None,
                keywords=None, fallback: Column | None = None) -> DataFrame:
    """Alias -> canned answer -> search + relevant sentences (else first
    line) -> ``fallback`` (null unless given: the place of a general model).

    Only rows without a canned answer reach the search (short circuit), so
    the BM25 join never sees already answered questions.
    Returns (q_id, search_query, doc_id, answer, source)."""
    q = alias_lookup(questions.select(F.col(q_id).alias("_rid"), F.col(q_col).alias("_q")), "_q", aliases)
    q = canned_answer(q, "search_query", canned)
    pending = q.where(F.col("canned").isNull())
    found = _search(pending, corpus, d_id, d_text)
    rel = relevant_sentences(F.col("summary"), keywords)
    found = found.select("_rid", "doc_id",
                         F.coalesce(rel, first_line(F.col("summary"))).alias("found"),
                         F.when(rel.isNotNull(), F.lit("search")).otherwise(F.lit("first_line")).alias("_src"))
    general = fallback if fallback is not None else F.lit(None).cast("string")
    out = q.join(found, "_rid", "left")
    answer = F.coalesce(F.col("canned"), F.col("found"), general)
    source = (F.when(F.col("canned").isNotNull(), F.lit("canned"))
              .when(F.col("found").isNotNull(), F.col("_src")).otherwise(F.lit("general")))
    return out.select(F.col("_rid").alias(q_id), "search_query", "doc_id", answer.alias("answer"), source.alias("source"))


def not_helpful(feedback: DataFrame, helpful_col: str = "helpful") -> DataFrame:
    """Entries that trigger a correction (a missing flag counts as negative)."""
    return feedback.where(~F.coalesce(F.col(helpful_col), F.lit(False)))


def correct_answers(feedback: DataFrame, f_id: str, q_col: str, corpus: DataFrame, d_id: str = "doc_id",
                    d_text: str = "text", helpful_col: str = "helpful", aliases: DataFrame | None = None,
                    keywords=None) -> DataFrame:
    """For negative feedback, search again and return the first sentence
    with a correction keyword, else the page's first line, else a fixed
    'no better answer' text.  Returns (f_id, doc_id, corrected)."""
    neg = not_helpful(feedback, helpful_col)
    q = alias_lookup(neg.select(F.col(f_id).alias("_rid"), F.col(q_col).alias("_q")), "_q", aliases)
    found = _search(q, corpus, d_id, d_text)
    found = found.select("_rid", "doc_id",
                         F.coalesce(first_matching_sentence(F.col("summary"), keywords),
                                    first_line(F.col("summary"))).alias("found"))
    out = q.join(found, "_rid", "left")
    return out.select(F.col("_rid").alias(f_id), "doc_id",
                      F.coalesce(F.col("found"), F.lit(defaults.NO_BETTER_ANSWER)).alias("corrected"))


def latest_context(df: DataFrame, key: str, text_col: str, version_col: str) -> DataFrame:
    """The last text per key (last writer wins): ``max_by`` aggregate,
    partially aggregated map-side, one row of state per key."""
    return df.groupBy(key).agg(F.max_by(text_col, version_col).alias("context"))


def require_context(questions: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """P12 + J07: questions joined with their key's context; ``error`` set when
    there is none (or it is empty)."""
    out = questions.join(contexts, key, "left")
    missing = F.col("context").isNull() | (F.col("context") == "")
    return out.withColumn("error", F.when(missing, F.lit(defaults.NO_CONTEXT_ERROR)))


def answer_from_context(questions: DataFrame, contexts: DataFrame, key: str, q_col: str = "question",
                        context_chars: int | None = None) -> DataFrame:
    """T05 (extractive): of the whole context, the sentence sharing most distinct terms with
    the question (ties -> earliest), cleaned by F02; ``confidence`` = shared
    terms / question terms; error instead of an answer when no context."""
    joined = require_context(questions, contexts, key)
    ctx = F.col("context") if context_chars is None else truncate_chars("context", context_chars)
    qterms = F.array_distinct(terms(F.col(q_col)))
    sents = F.filter(F.transform(split_sentences(ctx), lambda s, i: F.struct(i.alias("pos"), s.alias("s"))),
                     lambda x: x["s"] != "")
    scored = F.transform(sents, lambda x: F.struct(
        F.size(F.array_intersect(qterms, F.array_distinct(terms(x["s"])))).alias("score"),
        (-x["pos"]).alias("neg_pos"), x["s"].alias("s")))
    best = F.array_max(scored)
    n_q = F.size(qterms)
    out = joined.withColumn("_best", F.when(F.col("error").isNull(), best))
    return out.select(
        "*",
        F.when(F.col("error").isNull(), clean_response(F.coalesce(F.col("_best.s"), F.lit("")))).alias("answer"),
        F.when(F.col("error").isNull() & (n_q > 0),
               round_half_up(F.coalesce(F.col("_best.score"), F.lit(0)) / n_q, 6)).alias("confidence")
    ).drop("_best")


def confidence_gate(answer: Column, confidence: Column, threshold: float = defaults.CONFIDENCE_THRESHOLD,
                    message: str = defaults.CLARIFY_MESSAGE) -> Column:
    """Clarification message below the threshold; a missing confidence passes."""
    return F.when(confidence < threshold, F.lit(message)).otherwise(answer)


def answer_or_error(answer: Column, error: Column) -> Column:
    """First non-empty of answer, error."""
    return F.coalesce(F.nullif(answer, F.lit("")), error)


def search_by_term_location(supplier: DataFrame, nation: DataFrame, region: DataFrame,
                            term: str, location: str) -> DataFrame:
    """Businesses whose name contains ``term`` located in a nation or
    region named ``location`` (dimension joins; the dimensions are tiny and
    broadcast by the planner)."""
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    out = supplier.join(geo, supplier.s_nationkey == geo.n_nationkey)
    loc = location.lower()
    return out.where(F.contains(F.lower("s_name"), F.lit(term.lower())) &
                     ((F.lower("n_name") == loc) | (F.lower("r_name") == loc))) \
        .select("s_suppkey", "s_name", "n_name", "r_name", "s_acctbal")


def missing_pages(titles: DataFrame, corpus: DataFrame, title_col: str = "title") -> DataFrame:
    """Titles with no page (left-anti join)."""
    return titles.join(corpus.select(title_col).distinct(), title_col, "left_anti")


__all__ = ["alias_lookup", "canned_answer", "keyword_match", "bm25_top1", "relevant_sentences",
           "first_matching_sentence", "fact_answer", "not_helpful", "correct_answers", "latest_context",
           "require_context", "answer_from_context", "confidence_gate", "answer_or_error",
           "search_by_term_location", "missing_pages"]
