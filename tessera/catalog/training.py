"""Training-set queries: W01, M01-M08, J04, J10, U02, F05, S15 (keyed form), S16."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import defaults
from ..operators import training as M
from ..plans.pages import page_extract
from .common import lit, strip_ws, table
from .retrieval import PAIRS_SQL, terms_sql
from .sqltext import page_cte

#: Words that have an id of their own; a parameter of M05, far above the fixtures' need for a table of embeddings.
VOCAB_SIZE = 50_000
MAX_LEN = 128


def _pairs(spark, sf):
    return M.pair_turns(table(spark, sf, "conversations"))


def _pair_key():
    return M.pair_key(F.col("conv_id"), F.col("q_turn"))


def q_pair_turns(spark, sf):
    return _pairs(spark, sf).select("conv_id", "q_turn", "a_turn")


def q_qa_pairs(spark, sf):
    return _pairs(spark, sf)


def _prefixed_lines(spark, sf):
    c = table(spark, sf, "conversations")
    line = (F.when(F.col("role") == "user", F.concat(F.lit(defaults.QUESTION_SPEAKER + " "), "text"))
            .when(F.col("role") == "assistant", F.concat(F.lit(defaults.ANSWER_SPEAKER + " "), "text"))
            .otherwise(F.col("text")))
    return c.select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), line.alias("text"))


def q_starts_with_speaker(spark, sf):
    return M.lines_to_turns(_prefixed_lines(spark, sf))


def q_train_eval_split(spark, sf):
    return M.train_eval_split(_pairs(spark, sf), _pair_key()).select("conv_id", "q_turn", "split")


def q_same_split(spark, sf):
    return M.train_eval_split(_pairs(spark, sf), _pair_key(), None).select("conv_id", "q_turn", "split")


def q_train_eval_complement(spark, sf):
    return M.split_check(M.train_eval_split(_pairs(spark, sf), _pair_key()), _pair_key())


def _vocab(spark, sf):
    return M.build_vocab(table(spark, sf, "documents"), ["text"], VOCAB_SIZE)


def q_build_vocab(spark, sf):
    return _vocab(spark, sf)


def _ids_text(c):
    return F.array_join(F.col(c), " ")


def q_tokenize_pad(spark, sf):
    t = M.tokenize_pad(table(spark, sf, "benchmark"), "item_id", "text", _vocab(spark, sf), MAX_LEN,
                       vocab_size=VOCAB_SIZE)
    return t.select("item_id", _ids_text("input_ids").alias("input_ids"),
                    _ids_text("attention_mask").alias("attention_mask"),
                    F.size("input_ids").cast("long").alias("length"))


def q_vocab_join(spark, sf):
    b = table(spark, sf, "benchmark")
    v = _vocab(spark, sf)
    toks = b.select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
                    .alias("pos", "token"))
    out = toks.join(v, "token", "left")
    return out.select("item_id", F.col("pos").cast("long").alias("pos"), "token",
                      F.coalesce("id", F.lit(M.UNK_ID)).alias("token_id"))


def q_label_pairs(spark, sf):
    p = _pairs(spark, sf).withColumn("pair_id", _pair_key())
    lp = M.label_pairs(p, "pair_id", _vocab(spark, sf), MAX_LEN, vocab_size=VOCAB_SIZE)
    return lp.select("pair_id", _ids_text("input_ids").alias("input_ids"), _ids_text("labels").alias("labels"))


def _page_corpus(spark, sf):
    ex = page_extract(table(spark, sf, "pages"))
    return ex.select("page_id", "url", "title", F.col("text").alias("summary"))


def _title_list(spark, sf):
    pages = _page_corpus(spark, sf).select("title")
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("title"))
    return pages.unionByName(nations)


def q_qa_triples(spark, sf):
    return M.qa_triples(_page_corpus(spark, sf))


def q_topic_corpus(spark, sf):
    corpus = _page_corpus(spark, sf).withColumnRenamed("summary", "text")
    return M.topic_corpus(_title_list(spark, sf), corpus)


def q_title_list_join(spark, sf):
    corpus = _page_corpus(spark, sf)
    return corpus.join(_title_list(spark, sf).distinct(), "title").select("title", "page_id")


def q_fetch_by_titles(spark, sf):
    corpus = _page_corpus(spark, sf)
    return corpus.join(_title_list(spark, sf).distinct(), "title", "left_semi") \
        .where(F.length("summary") > 0).select("title", "url", "summary")


def q_skip_empty(spark, sf):
    return _page_corpus(spark, sf).where(F.length("summary") > 0).select("page_id")


QUERIES = {
    "pair_turns": q_pair_turns,
    "qa_pairs": q_qa_pairs,
    "starts_with_speaker": q_starts_with_speaker,
    "train_eval_split": q_train_eval_split,
    "same_split": q_same_split,
    "train_eval_complement": q_train_eval_complement,
    "build_vocab": q_build_vocab,
    "tokenize_pad": q_tokenize_pad,
    "vocab_join": q_vocab_join,
    "label_pairs": q_label_pairs,
    "qa_triples": q_qa_triples,
    "topic_corpus": q_topic_corpus,
    "title_list_join": q_title_list_join,
    "fetch_by_titles": q_fetch_by_titles,
    "skip_empty": q_skip_empty,
}

# ----------------------------------------------------------------- oracle SQL
SPLIT = """CASE WHEN substring(md5(conv_id::VARCHAR || ':' || q_turn::VARCHAR), 1, 16) < '1999999999999999' THEN 'eval' ELSE 'train' END"""
VOCAB_SQL = f"""vc AS (SELECT token, count(*) AS n FROM (SELECT unnest({terms_sql('text')}) AS token FROM documents) GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 1)::INTEGER AS id FROM vc ORDER BY n DESC, token LIMIT {VOCAB_SIZE})"""


def tokenize_sql(src: str, id_col: str, text_col: str, name: str) -> str:
    """CTE {name}(id, ids list, mask list)."""
    return f"""{name}_t AS (SELECT {id_col} AS id, {terms_sql(text_col)}[1:{MAX_LEN}] AS toks FROM {src}),
{name}_e AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM {name}_t),
{name}_j AS (SELECT {name}_e.id, pos, coalesce(vocab.id, 1) AS tid FROM {name}_e LEFT JOIN vocab USING (token)),
{name}_g AS (SELECT {name}_t.id, coalesce(list(tid ORDER BY pos) FILTER (WHERE tid IS NOT NULL), []) AS real
  FROM {name}_t LEFT JOIN {name}_j ON {name}_t.id = {name}_j.id GROUP BY {name}_t.id),
{name} AS (SELECT id, list_concat(real, list_resize([]::INTEGER[], greatest({MAX_LEN} - len(real), 0), 0)) AS ids,
  list_concat(list_resize([]::INTEGER[], len(real), 1), list_resize([]::INTEGER[], greatest({MAX_LEN} - len(real), 0), 0)) AS mask FROM {name}_g)"""


_PE = page_cte("pages")
TITLES = "tl AS (SELECT title FROM pe UNION ALL SELECT n_name AS title FROM nation)"


def _lines_sql():
    line = f"""CASE WHEN role = 'user' THEN {lit(defaults.QUESTION_SPEAKER + ' ')} || text
  WHEN role = 'assistant' THEN {lit(defaults.ANSWER_SPEAKER + ' ')} || text ELSE text END"""
    q, a = lit(defaults.QUESTION_SPEAKER), lit(defaults.ANSWER_SPEAKER)
    return f"""WITH l AS (SELECT conv_id, turn, {line} AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with(t, {q}) THEN 'user' WHEN starts_with(t, {a}) THEN 'assistant' ELSE 'other' END AS role,
  CASE WHEN starts_with(t, {q}) THEN {strip_ws(f'replace(t, {q}, {lit("")})')}
       WHEN starts_with(t, {a}) THEN {strip_ws(f'replace(t, {a}, {lit("")})')} ELSE t END AS text FROM l"""


SQL = {
    "pair_turns": f"WITH {PAIRS_SQL} SELECT conv_id, q_turn, a_turn FROM pairs",
    "qa_pairs": f"WITH {PAIRS_SQL} SELECT * FROM pairs",
    "starts_with_speaker": _lines_sql(),
    "train_eval_split": f"WITH {PAIRS_SQL} SELECT conv_id, q_turn, {SPLIT} AS split FROM pairs",
    "same_split": f"WITH {PAIRS_SQL} SELECT conv_id, q_turn, unnest(['train', 'eval']) AS split FROM pairs",
    "train_eval_complement": f"""WITH {PAIRS_SQL}, s AS (SELECT conv_id, q_turn, {SPLIT} AS split FROM pairs)
SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE split = 'train')::BIGINT AS n_train,
  count(*) FILTER (WHERE split = 'eval')::BIGINT AS n_eval,
  (SELECT count(*) FROM (SELECT conv_id, q_turn FROM s WHERE split = 'train' INTERSECT SELECT conv_id, q_turn FROM s WHERE split = 'eval'))::BIGINT AS n_overlap,
  (SELECT count(*) FROM (SELECT conv_id, q_turn FROM s WHERE split = 'train' UNION SELECT conv_id, q_turn FROM s WHERE split = 'eval'))::BIGINT AS n_union
FROM s""",
    "build_vocab": f"WITH {VOCAB_SQL} SELECT token, id FROM vocab",
    "tokenize_pad": f"""WITH {VOCAB_SQL}, {tokenize_sql('benchmark', 'item_id', 'text', 'tk')}
SELECT id AS item_id, array_to_string(ids, ' ') AS input_ids, array_to_string(mask, ' ') AS attention_mask, len(ids)::BIGINT AS length FROM tk""",
    "vocab_join": f"""WITH {VOCAB_SQL}, e AS (SELECT item_id, unnest({terms_sql('text')}) AS token,
  (generate_subscripts({terms_sql('text')}, 1) - 1)::BIGINT AS pos FROM benchmark)
SELECT item_id, pos, e.token, coalesce(vocab.id, 1) AS token_id FROM e LEFT JOIN vocab ON e.token = vocab.token""",
    "label_pairs": f"""WITH {PAIRS_SQL}, pp AS (SELECT conv_id::VARCHAR || ':' || q_turn::VARCHAR AS pair_id, question, answer FROM pairs),
{VOCAB_SQL}, {tokenize_sql('pp', 'pair_id', 'question', 'tq')}, {tokenize_sql('pp', 'pair_id', 'answer', 'ta')}
SELECT tq.id AS pair_id, array_to_string(tq.ids, ' ') AS input_ids, array_to_string(ta.ids, ' ') AS labels FROM tq JOIN ta ON tq.id = ta.id""",
    "qa_triples": f"""WITH {_PE} SELECT text AS context, 'What is ' || title || '?' AS question, split_part(text, '.', 1) AS answer
FROM pe WHERE length(text) > 0""",
    "topic_corpus": f"WITH {_PE}, {TITLES} SELECT title, text AS text FROM pe WHERE title IN (SELECT title FROM tl)",
    "title_list_join": f"WITH {_PE}, {TITLES} SELECT title, page_id FROM pe JOIN (SELECT DISTINCT title FROM tl) USING (title)",
    "fetch_by_titles": f"""WITH {_PE}, {TITLES} SELECT title, url, text AS summary FROM pe
WHERE title IN (SELECT title FROM tl) AND length(text) > 0""",
    "skip_empty": f"WITH {_PE} SELECT page_id FROM pe WHERE length(text) > 0",
}
