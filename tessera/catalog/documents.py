"""Document/text queries: A01, P05, T01-T03, J08, A12, L06, F01-F15."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import defaults
from ..functions import text as X
from ..operators.sentiment import lexicon_matches, sentiment_scores
from ..operators.text import WORD_TOKEN, TERM_TOKEN, corpus_top_terms, extractive_summary, word_frequencies
from .common import lit, round6, rx_sub, strip_ws, table, values, word_count as sql_wc
from .sqltext import sentiment_ctes


def docs(spark, sf):
    return table(spark, sf, "documents")


def q_word_count(spark, sf):
    return docs(spark, sf).select("doc_id", X.word_count("text").alias("word_count"))


def q_truncate_chars(spark, sf):
    return docs(spark, sf).select("doc_id", X.truncate_chars("text", defaults.TEXT_BUDGET).alias("head"))


def q_polarity_subjectivity(spark, sf):
    return sentiment_scores(docs(spark, sf), "doc_id").select("doc_id", "polarity", "subjectivity")


def q_valence_scores(spark, sf):
    return sentiment_scores(docs(spark, sf), "doc_id").select(
        "doc_id", "positivity", "negativity", "neutrality", "compound")


def q_lexicon_join(spark, sf):
    return lexicon_matches(docs(spark, sf), "doc_id")


def q_word_frequencies(spark, sf):
    return word_frequencies(docs(spark, sf), "doc_id")


def q_word_collocations(spark, sf):
    return word_frequencies(docs(spark, sf), "doc_id", collocations=True)


def q_top_terms(spark, sf):
    return corpus_top_terms(word_frequencies(docs(spark, sf), "doc_id"))


def q_extractive_summary(spark, sf):
    return extractive_summary(docs(spark, sf), "doc_id")


def q_split_sentences(spark, sf):
    d = docs(spark, sf).select("doc_id", F.posexplode(X.split_sentences("text")).alias("pos", "sentence"))
    return d.withColumn("pos", F.col("pos").cast("long"))


def q_first_line(spark, sf):
    return docs(spark, sf).select("doc_id", X.first_line("text").alias("first_line"))


def q_first_sentence(spark, sf):
    return docs(spark, sf).select("doc_id", X.first_sentence("text").alias("first_sentence"))


def q_trim_whitespace(spark, sf):
    return docs(spark, sf).select("doc_id", X.strip_ws(X.first_line(F.col("text"))).alias("stripped"),
                                  X.strip_ws("text").alias("text_stripped"))


def q_contains_any(spark, sf):
    # long keyword list over whole documents: one Aho-Corasick pass per text
    return docs(spark, sf).select("doc_id", X.contains_any(F.lower("text"), defaults.FACT_KEYWORDS).alias("relevant"),
                                  X.contains_any(F.lower("text"), defaults.CORRECTION_KEYWORDS).alias("correction"))


def q_clean_response(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.clean_response("text").alias("answer"))


def q_normalize_question(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", X.normalize_question("text").alias("lookup_key"),
                    X.drop_question_marks("text").alias("search_query"))


def q_base64_codec(spark, sf):
    d = docs(spark, sf).select("doc_id", X.to_base64("text").alias("b64"), "text")
    return d.select("doc_id", "b64", (X.from_base64("b64") == F.col("text")).alias("round_trip"))


def q_to_string(spark, sf):
    c = table(spark, sf, "customer")
    bal = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal"))
    return c.select("c_custkey", X.to_string_nan(bal).alias("acctbal_text"),
                    X.to_string_nan("c_nationkey").alias("nation_text"))


def q_bounded_length(spark, sf):
    return docs(spark, sf).select("doc_id", X.bounded_length("text").alias("summary_max_tokens"))


def q_question_template(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", X.question_template("n_name").alias("question"))


def q_build_prompt(spark, sf):
    b = table(spark, sf, "benchmark")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context"))
    return b.join(d, "item_id").select(
        "item_id", X.build_prompt("context", "text", defaults.GENERAL_PROMPT).alias("prompt"),
        X.build_prompt("context", "text", defaults.CONTEXT_PROMPT).alias("context_prompt"))


def q_metadata_text(spark, sf):
    e = table(spark, sf, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", X.metadata_text(m).alias("meta_text"))


QUERIES = {
    "word_count": q_word_count,
    "truncate_chars": q_truncate_chars,
    "polarity_subjectivity": q_polarity_subjectivity,
    "valence_scores": q_valence_scores,
    "lexicon_join": q_lexicon_join,
    "word_frequencies": q_word_frequencies,
    "word_collocations": q_word_collocations,
    "top_terms": q_top_terms,
    "extractive_summary": q_extractive_summary,
    "split_sentences": q_split_sentences,
    "first_line": q_first_line,
    "first_sentence": q_first_sentence,
    "trim_whitespace": q_trim_whitespace,
    "contains_any": q_contains_any,
    "clean_response": q_clean_response,
    "normalize_question": q_normalize_question,
    "base64_codec": q_base64_codec,
    "to_string": q_to_string,
    "bounded_length": q_bounded_length,
    "question_template": q_question_template,
    "build_prompt": q_build_prompt,
    "metadata_text": q_metadata_text,
}

NUMBER_ONLY = r"^\p{N}+$"
STOP = values([(w,) for w in defaults.STOP_WORDS], ["word"], "sw")


def _contains_any_sql(x, kws):
    return "(" + " OR ".join(f"contains({x}, {lit(k)})" for k in kws) + ")"


def clean_response_sql(r: str) -> str:
    body = f"CASE WHEN contains({r}, 'Answer:') THEN {strip_ws(f'split_part({r}, {lit(chr(65) + 'nswer:')}, 2)')} ELSE {r} END"
    sent = f"(split_part({body}, '.', 1) || '.')"
    head = f"substring({sent}, 1, 150)"
    cut = (f"CASE WHEN instr({head}, ' ') > 0 THEN substring({head}, 1, length({head}) - instr(reverse({head}), ' ')) "
           f"ELSE {head} END")
    return f"CASE WHEN length({sent}) > 150 THEN {cut} || '...' ELSE {sent} END"


def _fold_sql(name: str, src: str, key: str, sp: str) -> str:
    """CTE {name}(doc_id, key, fk, sp, c): plural folding of (doc_id, key, spelling, c) rows."""
    return f"""{name}_a AS (SELECT doc_id, {key} AS key, {sp} AS w, c,
  CASE WHEN ends_with({key}, 's') AND NOT ends_with({key}, 'ss') THEN substring({key}, 1, length({key}) - 1) ELSE {key} END AS stem FROM {src}),
{name}_b AS (SELECT *, max((key = stem)::INT) OVER (PARTITION BY doc_id, stem) = 1 AS has_sing FROM {name}_a),
{name} AS (SELECT doc_id, key, CASE WHEN has_sing THEN stem ELSE key END AS fk,
  CASE WHEN key = stem THEN w WHEN has_sing THEN substring(w, 1, length(w) - 1) ELSE w END AS sp, c FROM {name}_b)"""


def _groups_sql(name: str, src: str) -> str:
    """CTE {name}(doc_id, fk, n, term)."""
    return f"""{name}_s AS (SELECT doc_id, fk, sp, sum(c) AS c FROM {src} GROUP BY 1, 2, 3),
{name} AS (SELECT doc_id, fk, sum(c) AS n, arg_max(sp, (c, sp)) AS term FROM {name}_s GROUP BY 1, 2)"""


def _llr_sql(k, n, x):
    return f"(({k}) * ln(greatest({x}, 1e-10)) + (({n}) - ({k})) * ln(greatest(1.0 - ({x}), 1e-10)))"


_APOS_S = lit("'s")


def wf_ctes(collocations: bool, src: str = "documents", id_col: str = "doc_id") -> str:
    """CTE chain ending in ``wf``(doc_id, term, n, weight, rank)."""
    head = f"""d AS (SELECT {id_col} AS doc_id, text AS t FROM {src}),
tk AS (SELECT doc_id, unnest(regexp_extract_all(t, {lit(WORD_TOKEN)}, 0)) AS w0,
  generate_subscripts(regexp_extract_all(t, {lit(WORD_TOKEN)}, 0), 1) AS pos FROM d),
tk2 AS (SELECT doc_id, pos, CASE WHEN ends_with(lower(w0), {_APOS_S}) THEN substring(w0, 1, length(w0) - 2) ELSE w0 END AS w FROM tk),
tk3 AS (SELECT doc_id, pos, w, lower(w) AS key FROM tk2 WHERE NOT regexp_matches(w, {lit(NUMBER_ONLY)})),
tk4 AS (SELECT tk3.*, sw.word IS NOT NULL AS stop FROM tk3 LEFT JOIN {STOP} ON tk3.key = sw.word),
forms AS (SELECT doc_id, key, w, count(*) AS c FROM tk4 WHERE NOT stop GROUP BY 1, 2, 3),
{_fold_sql('uf', 'forms', 'key', 'w')},
{_groups_sql('words', 'uf')},"""
    coll = f"""pr AS (SELECT doc_id, w, key, stop, lead(w) OVER win AS w2, lead(key) OVER win AS key2, lead(stop) OVER win AS stop2
  FROM tk4 WINDOW win AS (PARTITION BY doc_id ORDER BY pos)),
bf AS (SELECT doc_id, key || ' ' || key2 AS bkey, w || ' ' || w2 AS bw, count(*) AS c FROM pr
  WHERE key2 IS NOT NULL AND NOT stop AND NOT stop2 GROUP BY 1, 2, 3),
{_fold_sql('bfo', 'bf', 'bkey', 'bw')},
{_groups_sql('bigrams', 'bfo')},
keymap AS (SELECT DISTINCT doc_id, key, fk FROM uf),
nw AS (SELECT doc_id, sum(n) AS n_words FROM words GROUP BY 1),
bj AS (SELECT b.doc_id, b.term, b.n::DOUBLE AS c12, k1.fk AS fk1, k2.fk AS fk2 FROM bigrams b
  LEFT JOIN keymap k1 ON k1.doc_id = b.doc_id AND k1.key = split_part(lower(b.term), ' ', 1)
  LEFT JOIN keymap k2 ON k2.doc_id = b.doc_id AND k2.key = split_part(lower(b.term), ' ', 2)),
bs AS (SELECT bj.*, w1.n::DOUBLE AS c1, w2.n::DOUBLE AS c2, nw.n_words::DOUBLE AS nn FROM bj
  LEFT JOIN words w1 ON w1.doc_id = bj.doc_id AND w1.fk = bj.fk1
  LEFT JOIN words w2 ON w2.doc_id = bj.doc_id AND w2.fk = bj.fk2 JOIN nw ON nw.doc_id = bj.doc_id),
bsc AS (SELECT *, c2 / nn AS p, c12 / c1 AS p1, CASE WHEN nn - c1 > 0 THEN (c2 - c12) / (nn - c1) ELSE 0.0 END AS p2 FROM bs),
coll AS (SELECT doc_id, fk1, fk2, term, c12::BIGINT AS n FROM bsc
  WHERE -2.0 * ({_llr_sql('c12', 'c1', 'p')} + {_llr_sql('c2 - c12', 'nn - c1', 'p')} - {_llr_sql('c12', 'c1', 'p1')} - {_llr_sql('c2 - c12', 'nn - c1', 'p2')}) > {defaults.COLLOCATION_THRESHOLD}),
taken AS (SELECT doc_id, fk, sum(d) AS d FROM (SELECT doc_id, fk1 AS fk, n AS d FROM coll UNION ALL SELECT doc_id, fk2, n FROM coll) GROUP BY 1, 2),
terms AS (SELECT w.doc_id, w.term, w.n - coalesce(t.d, 0) AS n FROM words w LEFT JOIN taken t ON w.doc_id = t.doc_id AND w.fk = t.fk
  WHERE w.n - coalesce(t.d, 0) > 0 UNION ALL SELECT doc_id, term, n FROM coll),"""
    tail = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term ASC) AS rank,
  max(n) OVER (PARTITION BY doc_id) AS mx FROM terms),
wf AS (SELECT doc_id, term, n::BIGINT AS n, {round6('n / mx')} AS weight, rank::BIGINT AS rank FROM rk)"""
    terms = coll if collocations else "terms AS (SELECT doc_id, term, n FROM words),"
    return head + "\n" + terms + "\n" + tail


_WF_CTES = wf_ctes(False)
_WF_COLL_CTES = wf_ctes(True)
_WF = "WITH " + _WF_CTES

def summary_ctes(src: str = "documents", id_col: str = "doc_id", text_expr: str = "text",
                 budget: str = str(defaults.SUMMARY_TOKEN_BUDGET)) -> str:
    """CTE chain ending in ``summ``(doc_id, summary, n_sentences) for the C11 rule."""
    return f"""sd AS (SELECT {id_col} AS doc_id, {text_expr} AS t, {budget} AS bud FROM {src}),
s0 AS (SELECT doc_id, bud, unnest(string_split(t, '.')) AS raw, generate_subscripts(string_split(t, '.'), 1) - 1 AS pos FROM sd),
s AS (SELECT doc_id, bud, pos, {strip_ws('raw')} AS sentence FROM s0),
s1 AS (SELECT * FROM s WHERE sentence <> ''),
tm AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), {lit(TERM_TOKEN)}, 0)) AS term FROM s1),
tm2 AS (SELECT * FROM tm WHERE term NOT IN (SELECT word FROM {STOP})),
fq AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, term)::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS freq FROM tm2),
sc AS (SELECT doc_id, pos, avg(freq) AS score FROM fq GROUP BY doc_id, pos),
rk0 AS (SELECT s1.doc_id, s1.bud, s1.pos, s1.sentence, {round6('coalesce(sc.score, 0.0)')} AS score, {sql_wc('s1.sentence')} AS nw
  FROM s1 LEFT JOIN sc ON s1.doc_id = sc.doc_id AND s1.pos = sc.pos),
srk AS (SELECT *, row_number() OVER w AS rnk, sum(nw) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM rk0 WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, pos ASC)),
summ AS (SELECT doc_id, string_agg(sentence, '. ' ORDER BY pos) || '.' AS summary, count(*)::BIGINT AS n_sentences
  FROM srk WHERE rnk = 1 OR running <= bud GROUP BY doc_id)"""


_SUMMARY_CTES = summary_ctes()
_SUMMARY = "WITH " + _SUMMARY_CTES + " SELECT * FROM summ"

def prompt_sql(template: str) -> str:
    parts = template.replace("{context}", "\0d\0").replace("{question}", "\0b\0").split("\0")
    return " || ".join({"d": "substring(d.text, 1, 1000)", "b": "b.text"}.get(p) or lit(p) for p in parts if p)


_SENTI = sentiment_ctes("documents", "doc_id", "text")

SQL = {
    "word_count": f"SELECT doc_id, {sql_wc('text')} AS word_count FROM documents",
    "truncate_chars": f"SELECT doc_id, substring(text, 1, {defaults.TEXT_BUDGET}) AS head FROM documents",
    "polarity_subjectivity": f"WITH {_SENTI} SELECT id AS doc_id, polarity, subjectivity FROM senti",
    "valence_scores": f"WITH {_SENTI} SELECT id AS doc_id, positivity, negativity, neutrality, compound FROM senti",
    "lexicon_join": f"WITH {_SENTI} SELECT id AS doc_id, key, count(*)::BIGINT AS n FROM senti_j WHERE kind = 'word' GROUP BY 1, 2",
    "word_frequencies": _WF + " SELECT * FROM wf",
    "word_collocations": "WITH " + _WF_COLL_CTES + " SELECT * FROM wf",
    "top_terms": _WF + f""" SELECT lower(term) AS term, sum(n)::BIGINT AS n FROM wf GROUP BY 1
  ORDER BY n DESC, term ASC LIMIT {defaults.WORDCLOUD_MAX_WORDS}""",
    "extractive_summary": _SUMMARY,
    "split_sentences": f"""SELECT doc_id, (generate_subscripts(string_split(text, '.'), 1) - 1)::BIGINT AS pos,
  {strip_ws("unnest(string_split(text, '.'))")} AS sentence FROM documents""",
    "first_line": "SELECT doc_id, split_part(text, chr(10), 1) AS first_line FROM documents",
    "first_sentence": "SELECT doc_id, split_part(text, '.', 1) AS first_sentence FROM documents",
    "trim_whitespace": f"SELECT doc_id, {strip_ws('split_part(text, chr(10), 1)')} AS stripped, {strip_ws('text')} AS text_stripped FROM documents",
    "contains_any": f"""SELECT doc_id, {_contains_any_sql('lower(text)', defaults.FACT_KEYWORDS)} AS relevant,
  {_contains_any_sql('lower(text)', defaults.CORRECTION_KEYWORDS)} AS correction FROM documents""",
    "clean_response": f"SELECT conv_id, turn, {clean_response_sql('text')} AS answer FROM conversations",
    "normalize_question": "SELECT item_id, lower(text) AS lookup_key, replace(text, '?', '') AS search_query FROM benchmark",
    "base64_codec": "SELECT doc_id, to_base64(encode(text)) AS b64, TRUE AS round_trip FROM documents",
    "to_string": """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END::VARCHAR, 'nan') AS acctbal_text,
  coalesce(c_nationkey::VARCHAR, 'nan') AS nation_text FROM customer""",
    "bounded_length": f"SELECT doc_id, least(floor(length(text) / 2), 100)::BIGINT AS summary_max_tokens FROM documents",
    "question_template": "SELECT n_nationkey, 'What is ' || n_name || '?' AS question FROM nation",
    "build_prompt": f"""SELECT item_id, {prompt_sql(defaults.GENERAL_PROMPT)} AS prompt, {prompt_sql(defaults.CONTEXT_PROMPT)} AS context_prompt
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id""",
    "metadata_text": "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS meta_text FROM events",
}
