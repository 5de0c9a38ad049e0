"""Retrieval / QA queries: J01-J07, J09, L03-L05, P08, P09, P11, P12, A14, T05-T07."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import defaults
from ..functions.text import first_line
from ..operators import retrieval as R
from ..operators.text import TERM_TOKEN
from ..operators.training import pair_key, pair_turns
from .common import lit, round6, strip_ws, table, values
from .documents import _contains_any_sql, clean_response_sql


def feedback_rows(spark, sf):
    """Feedback entries derived from the conversations: each question/answer
    pair plus a helpful flag from an md5 of its key (True / False / None)."""
    pairs = pair_turns(table(spark, sf, "conversations"))
    key = pair_key(F.col("conv_id"), F.col("q_turn"))
    h = F.substring(F.md5(key), 1, 1)
    helpful = F.when(h < "6", F.lit(True)).when(h < "c", F.lit(False))
    return pairs.select(key.alias("feedback_id"), "question", "answer", helpful.alias("helpful"))


def _user_turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


def _contexts(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return R.latest_context(c, "conv_id", "text", "turn")


def q_alias_lookup(spark, sf):
    b = table(spark, sf, "benchmark")
    return R.alias_lookup(b, "text").select("item_id", "search_query")


def q_canned_answer(spark, sf):
    b = R.alias_lookup(table(spark, sf, "benchmark"), "text")
    return R.canned_answer(b).select("item_id", "canned")


def q_keyword_match(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "sentence"))
    d = d.withColumn("pos", F.col("pos").cast("long"))
    return R.keyword_match(d, "sentence", defaults.FACT_KEYWORDS)


def q_retrieve_top1(spark, sf):
    return R.bm25_top1(table(spark, sf, "benchmark"), "item_id", "text", table(spark, sf, "documents"),
                       "doc_id", "text")


def q_top1_per_query(spark, sf):
    e = table(spark, sf, "events")
    best = e.groupBy("user_id").agg(F.min(F.struct((-F.col("value")).alias("nv"), F.col("event_id").alias("id"))).alias("m"))
    return best.select("user_id", F.col("m.id").alias("event_id"), (-F.col("m.nv")).alias("value"))


def _titles(spark, sf):
    from ..plans.pages import page_extract
    pages = page_extract(table(spark, sf, "pages"))
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("title"))
    return pages, pages.select("title").unionByName(nations)


def q_missing_pages(spark, sf):
    pages, titles = _titles(spark, sf)
    return R.missing_pages(titles, pages).distinct()


def q_question_context_join(spark, sf):
    return _user_turns(spark, sf).join(_contexts(spark, sf), "conv_id").select("conv_id", "turn", "question", "context")


def q_latest_context(spark, sf):
    return _contexts(spark, sf)


def q_search_by_term_location(spark, sf):
    return R.search_by_term_location(table(spark, sf, "supplier"), table(spark, sf, "nation"),
                                     table(spark, sf, "region"), "Supplier#00000001", "ASIA")


def q_fact_answer(spark, sf):
    return R.fact_answer(table(spark, sf, "benchmark"), "item_id", "text", table(spark, sf, "documents"))


def q_correct_answers(spark, sf):
    return R.correct_answers(feedback_rows(spark, sf), "feedback_id", "question", table(spark, sf, "documents"))


def _answers(spark, sf):
    return R.answer_from_context(_user_turns(spark, sf), _contexts(spark, sf), "conv_id")


def q_answer_from_context(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", "answer", "confidence", "error")


def q_confidence_gate(spark, sf):
    a = _answers(spark, sf)
    return a.select("conv_id", "turn", R.confidence_gate(F.col("answer"), F.col("confidence")).alias("shown"))


def q_answer_or_error(spark, sf):
    a = _answers(spark, sf)
    return a.select("conv_id", "turn", R.answer_or_error(F.col("answer"), F.col("error")).alias("shown"))


def q_not_helpful_filter(spark, sf):
    return R.not_helpful(feedback_rows(spark, sf)).select("feedback_id", "helpful")


def q_require_context(spark, sf):
    return R.require_context(_user_turns(spark, sf), _contexts(spark, sf), "conv_id").select("conv_id", "turn", "error")


def q_first_matching_sentence(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.coalesce(R.first_matching_sentence(F.col("text")), first_line(F.col("text"))).alias("answer"))


def q_all_matching_sentences(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.coalesce(R.relevant_sentences(F.col("text")), first_line(F.col("text"))).alias("answer"))


QUERIES = {
    "alias_lookup": q_alias_lookup,
    "canned_answer": q_canned_answer,
    "keyword_match": q_keyword_match,
    "retrieve_top1": q_retrieve_top1,
    "top1_per_query": q_top1_per_query,
    "missing_pages": q_missing_pages,
    "question_context_join": q_question_context_join,
    "latest_context": q_latest_context,
    "search_by_term_location": q_search_by_term_location,
    "fact_answer": q_fact_answer,
    "correct_answers": q_correct_answers,
    "answer_from_context": q_answer_from_context,
    "confidence_gate": q_confidence_gate,
    "answer_or_error": q_answer_or_error,
    "not_helpful_filter": q_not_helpful_filter,
    "require_context": q_require_context,
    "first_matching_sentence": q_first_matching_sentence,
    "all_matching_sentences": q_all_matching_sentences,
}

# ----------------------------------------------------------------- oracle SQL
ALIASES = values(defaults.ALIASES, ["alias", "title"], "al")
CANNED = values(defaults.CANNED_ANSWERS, ["question", "answer"], "ca")
KEYWORDS = values([(k,) for k in defaults.FACT_KEYWORDS], ["keyword"], "kw")


def terms_sql(x):
    return f"regexp_extract_all(lower({x}), {lit(TERM_TOKEN)}, 0)"


def bm25_sql(queries_sql: str, k1: float = 1.2, b: float = 0.75) -> str:
    """CTE chain ending in 'best'(qid, doc, score) for queries_sql(qid, q)."""
    return f"""qq AS ({queries_sql}),
q AS (SELECT DISTINCT qid, unnest({terms_sql('q')}) AS term FROM qq),
d AS (SELECT doc_id AS doc, {terms_sql('text')} AS toks FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(toks))::DOUBLE AS avgdl FROM d),
p0 AS (SELECT doc, len(toks) AS dl, unnest(toks) AS term FROM d),
p AS (SELECT doc, term, dl, count(*) AS tf FROM p0 WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
dfq AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT term, ln(1.0::DOUBLE + ((SELECT n FROM st) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM dfq),
sc AS (SELECT qid, doc, {round6(f'sum(idf * tf * {k1 + 1!r}::DOUBLE / (tf + {k1!r}::DOUBLE * ({1 - b!r}::DOUBLE + {b!r}::DOUBLE * dl / (SELECT avgdl FROM st))))')} AS score
  FROM p JOIN w USING (term) JOIN q USING (term) GROUP BY 1, 2),
best AS (SELECT qid, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rn FROM sc) WHERE rn = 1)"""


def split_strip(x):
    return f"list_transform(string_split({x}, '.'), lambda s: {strip_ws('s')})"


def relevant_sql(x, kws):
    picked = f"list_filter({split_strip(x)}, lambda s: {_contains_any_sql('lower(s)', kws)})"
    return f"CASE WHEN len({picked}) > 0 THEN array_to_string({picked}, ' ') END"


def first_match_sql(x, kws):
    return f"list_filter({split_strip(x)}, lambda s: {_contains_any_sql('lower(s)', kws)})[1]"


PAIRS_SQL = f"""k AS (SELECT conv_id, turn, role = 'user' AS is_q, text FROM conversations WHERE role IN ('user', 'assistant')),
k2 AS (SELECT *, lag(is_q) OVER w AS prev_is_q,
  coalesce(sum(CASE WHEN NOT is_q THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k3 AS (SELECT *, min(CASE WHEN is_q THEN turn END) OVER (PARTITION BY conv_id, run) AS qt FROM k2),
pairs AS (SELECT k3.conv_id, k3.qt AS q_turn, k3.turn AS a_turn, {strip_ws('q.text')} AS question, {strip_ws('k3.text')} AS answer
  FROM k3 JOIN k q ON q.conv_id = k3.conv_id AND q.turn = k3.qt WHERE NOT k3.is_q AND coalesce(k3.prev_is_q, FALSE))"""

FEEDBACK_SQL = PAIRS_SQL + """,
fb AS (SELECT conv_id::VARCHAR || ':' || q_turn::VARCHAR AS feedback_id, question, answer,
  CASE WHEN substring(md5(conv_id::VARCHAR || ':' || q_turn::VARCHAR), 1, 1) < '6' THEN TRUE
       WHEN substring(md5(conv_id::VARCHAR || ':' || q_turn::VARCHAR), 1, 1) < 'c' THEN FALSE END AS helpful FROM pairs)"""

CONTEXT_SQL = """ctx AS (SELECT conv_id, arg_max(text, turn) AS context FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
ut AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
rc AS (SELECT ut.*, ctx.context, CASE WHEN ctx.context IS NULL OR ctx.context = '' THEN """ + lit(defaults.NO_CONTEXT_ERROR) + """ END AS error
  FROM ut LEFT JOIN ctx USING (conv_id))"""


def _answers_sql():
    c = "context"
    return CONTEXT_SQL + f""",
qa AS (SELECT *, list_distinct({terms_sql('question')}) AS qterms,
  list_filter(list_transform({split_strip(c)}, lambda s, i: {{'pos': i - 1, 's': s}}), lambda x: x.s <> '') AS sents FROM rc),
qb AS (SELECT *, list_max(list_transform(sents, lambda x: {{'score': len(list_intersect(qterms, list_distinct({terms_sql('x.s')}))),
  'neg_pos': -x.pos, 's': x.s}})) AS best FROM qa),
ans AS (SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN {clean_response_sql("coalesce(best.s, '')")} END AS answer,
  CASE WHEN error IS NULL AND len(qterms) > 0 THEN {round6('coalesce(best.score, 0) / len(qterms)')} END AS confidence FROM qb)"""


SQL = {
    "alias_lookup": f"SELECT item_id, coalesce(al.title, replace(text, '?', '')) AS search_query FROM benchmark LEFT JOIN {ALIASES} ON lower(text) = al.alias",
    "canned_answer": f"""SELECT item_id, ca.answer AS canned FROM (SELECT item_id, coalesce(al.title, replace(text, '?', '')) AS sq
  FROM benchmark LEFT JOIN {ALIASES} ON lower(text) = al.alias) LEFT JOIN {CANNED} ON lower(sq) = ca.question""",
    "keyword_match": f"""SELECT doc_id, pos, sentence FROM (SELECT doc_id, (generate_subscripts(string_split(text, '.'), 1) - 1)::BIGINT AS pos,
  unnest(string_split(text, '.')) AS sentence FROM documents) s
  WHERE EXISTS (SELECT 1 FROM {KEYWORDS} WHERE contains(lower(s.sentence), lower(kw.keyword)))""",
    "retrieve_top1": f"WITH {bm25_sql('SELECT item_id AS qid, text AS q FROM benchmark')} SELECT qid AS item_id, doc AS doc_id, score FROM best",
    "top1_per_query": """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn
  FROM events) WHERE rn = 1""",
    "missing_pages": """SELECT DISTINCT n_name AS title FROM nation""",
    "question_context_join": f"WITH {CONTEXT_SQL} SELECT conv_id, turn, question, context FROM rc WHERE context IS NOT NULL",
    "latest_context": "SELECT conv_id, arg_max(text, turn) AS context FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "search_by_term_location": """SELECT s_suppkey, s_name, n_name, r_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(s_name), 'supplier#00000001') AND (lower(n_name) = 'asia' OR lower(r_name) = 'asia')""",
    "fact_answer": f"""WITH base AS (SELECT item_id, text, coalesce(al.title, replace(text, '?', '')) AS search_query
  FROM benchmark LEFT JOIN {ALIASES} ON lower(text) = al.alias),
cn AS (SELECT base.*, ca.answer AS canned FROM base LEFT JOIN {CANNED} ON lower(search_query) = ca.question),
{bm25_sql('SELECT item_id AS qid, search_query AS q FROM cn WHERE canned IS NULL')},
found AS (SELECT qid, doc AS doc_id, {relevant_sql('d.text', defaults.FACT_KEYWORDS)} AS rel, split_part(d.text, chr(10), 1) AS fl
  FROM best JOIN documents d ON d.doc_id = best.doc)
SELECT item_id, search_query, found.doc_id, coalesce(canned, rel, fl) AS answer,
  CASE WHEN canned IS NOT NULL THEN 'canned' WHEN found.qid IS NOT NULL AND rel IS NOT NULL THEN 'search'
       WHEN found.qid IS NOT NULL THEN 'first_line' ELSE 'general' END AS source
FROM cn LEFT JOIN found ON cn.item_id = found.qid""",
    "correct_answers": f"""WITH {FEEDBACK_SQL},
neg AS (SELECT feedback_id, coalesce(al.title, replace(question, '?', '')) AS search_query FROM fb
  LEFT JOIN {ALIASES} ON lower(question) = al.alias WHERE NOT coalesce(helpful, FALSE)),
{bm25_sql('SELECT feedback_id AS qid, search_query AS q FROM neg')},
found AS (SELECT qid, doc AS doc_id, coalesce({first_match_sql('d.text', defaults.CORRECTION_KEYWORDS)}, split_part(d.text, chr(10), 1)) AS f
  FROM best JOIN documents d ON d.doc_id = best.doc)
SELECT feedback_id, found.doc_id, coalesce(f, {lit(defaults.NO_BETTER_ANSWER)}) AS corrected FROM neg LEFT JOIN found ON neg.feedback_id = found.qid""",
    "answer_from_context": f"WITH {_answers_sql()} SELECT conv_id, turn, answer, confidence, error FROM ans",
    "confidence_gate": f"""WITH {_answers_sql()} SELECT conv_id, turn,
  CASE WHEN confidence < {defaults.CONFIDENCE_THRESHOLD} THEN {lit(defaults.CLARIFY_MESSAGE)} ELSE answer END AS shown FROM ans""",
    "answer_or_error": f"WITH {_answers_sql()} SELECT conv_id, turn, coalesce(nullif(answer, ''), error) AS shown FROM ans",
    "not_helpful_filter": f"WITH {FEEDBACK_SQL} SELECT feedback_id, helpful FROM fb WHERE NOT coalesce(helpful, FALSE)",
    "require_context": f"WITH {CONTEXT_SQL} SELECT conv_id, turn, error FROM rc",
    "first_matching_sentence": f"SELECT doc_id, coalesce({first_match_sql('text', defaults.CORRECTION_KEYWORDS)}, split_part(text, chr(10), 1)) AS answer FROM documents",
    "all_matching_sentences": f"SELECT doc_id, coalesce({relevant_sql('text', defaults.FACT_KEYWORDS)}, split_part(text, chr(10), 1)) AS answer FROM documents",
}
