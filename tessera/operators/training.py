"""Training-set preparation.

Conversation pairing is a per-conversation state machine re-expressed with
windows and aggregates: with roles reduced to questions and answers (others
ignored), the pending-question flag is set exactly when the previous kept
line is a question, and the open question is the first question after the
last answer.  So a pair is (first question of the run, answer) for every
answer whose previous kept line is a question.  Windows are bounded by turn
chunks, so one huge conversation is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults
from ..functions.text import first_sentence, question_template, strip_speaker, strip_ws
from ..session import scratch_path, ship_package
from .sentiment import checked_broadcast
from .text import TERM_TOKEN

# md5 prefix below which a key goes to the evaluation split: 0x1999.. / 0x10000.. = 0.1
EVAL_MD5_BOUND = "1999999999999999"
PAD_ID, UNK_ID, FIRST_WORD_ID = 0, 1, 2
MAX_VOCAB_BROADCAST = 5_000_000
MAX_VOCAB_ROW = 500_000       # tokens held by every Python worker (about 20 MB)


def pair_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text", ask_role: str = "user", answer_role: str = "assistant",
               chunk_turns: int = 1 << 20) -> DataFrame:
    """W01 + M01: (conv_id, q_turn, a_turn, question, answer), texts stripped.

    Skew-safe: turns are cut into chunks of ``chunk_turns``; windows run per
    (conversation, chunk), so no task holds more than one chunk of a
    conversation.  A per-chunk summary (answers in the chunk, role of its last
    kept line) is prefix-summed over the chunks of a conversation (one row per
    chunk) to carry the state across chunk boundaries.  The run index of a
    line is the number of answers before it; the first question of each run
    is a partially aggregated ``min`` per (conversation, run)."""
    is_ans = (~F.col("is_q")).cast("int")
    kept = df.where(F.col(role_col).isin(ask_role, answer_role)).select(
        F.col(conv_col), F.col(turn_col), (F.col(role_col) == ask_role).alias("is_q"), F.col(text_col),
        F.floor(F.col(turn_col) / chunk_turns).alias("_chunk"))
    chunks = kept.groupBy(conv_col, "_chunk").agg(
        F.sum(is_ans).alias("_n_ans"), F.max_by("is_q", turn_col).alias("_last_is_q"))
    wc = Window.partitionBy(conv_col).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(conv_col, "_chunk",
                           F.coalesce(F.sum("_n_ans").over(wc), F.lit(0)).alias("_ans_before"),
                           F.last("_last_is_q", ignorenulls=True).over(wc).alias("_carry_is_q"))
    wk = Window.partitionBy(conv_col, "_chunk").orderBy(turn_col)
    kept = kept.join(chunks, [conv_col, "_chunk"])
    kept = kept.select(
        conv_col, turn_col, "is_q", text_col,
        F.coalesce(F.lag("is_q").over(wk), F.col("_carry_is_q")).alias("prev_is_q"),
        (F.col("_ans_before") + F.coalesce(F.sum(is_ans).over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0))).alias("run"))
    first_q = kept.where(F.col("is_q")).groupBy(conv_col, "run").agg(
        F.min(F.struct(F.col(turn_col).alias("t"), F.col(text_col).alias("x"))).alias("fq"))
    answers = kept.where(~F.col("is_q") & F.coalesce(F.col("prev_is_q"), F.lit(False)))
    pairs = answers.join(first_q, [conv_col, "run"])
    return pairs.select(conv_col, F.col("fq.t").alias("q_turn"), F.col(turn_col).alias("a_turn"),
                        strip_ws(F.col("fq.x")).alias("question"), strip_ws(F.col(text_col)).alias("answer"))


def lines_to_turns(lines: DataFrame, seq_col: str = "path", line_col: str = "line_no", text_col: str = "text",
                   ask_prefix: str = defaults.QUESTION_SPEAKER, answer_prefix: str = defaults.ANSWER_SPEAKER) -> DataFrame:
    """S15 + F05: prefixed one-column lines -> (conv_id, turn, role, text);
    the prefix is removed everywhere in the line, lines without a known
    prefix get role 'other' (ignored by pairing)."""
    t = F.col(text_col)
    role = (F.when(t.startswith(ask_prefix), F.lit("user"))
            .when(t.startswith(answer_prefix), F.lit("assistant")).otherwise(F.lit("other")))
    text = (F.when(role == "user", strip_speaker(t, ask_prefix))
            .when(role == "assistant", strip_speaker(t, answer_prefix)).otherwise(t))
    return lines.select(F.col(seq_col).alias("conv_id"), F.col(line_col).alias("turn"), role.alias("role"),
                        text.alias("text"))


def pair_key(conv: Column, turn: Column) -> Column:
    return F.concat(conv.cast("string"), F.lit(":"), turn.cast("string"))


def train_eval_split(df: DataFrame, key: Column, eval_fraction: float | None = defaults.EVAL_FRACTION) -> DataFrame:
    """Adds ``split``.  Rows whose md5(key) hex is below the bound go
    to 'eval' (deterministic, no shuffle, stable under repartitioning).  With
    ``eval_fraction=None`` every row appears in both splits (train == eval)."""
    if eval_fraction is None:
        return df.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("eval"))))
    bound = format(int(eval_fraction * 16 ** 16), "016x")
    return df.withColumn("split", F.when(F.substring(F.md5(key.cast("string")), 1, 16) < F.lit(bound),
                                         F.lit("eval")).otherwise(F.lit("train")))


def build_vocab(corpus: DataFrame, text_cols: list[str], size: int) -> DataFrame:
    """(token, id) for the ``size`` most frequent lower-cased words
    (ties by token); ids start at 2 (0 = pad/end-of-text, 1 = unknown).
    The count is a distributed aggregation; ranking touches only the top
    ``size`` rows (TakeOrderedAndProject)."""
    toks = None
    for c in text_cols:
        t = corpus.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit(TERM_TOKEN), F.lit(0))).alias("token"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    w = Window.orderBy(F.desc("n"), F.asc("token"))  # over at most `size` rows
    return top.select("token", (F.row_number().over(w) + (FIRST_WORD_ID - 1)).cast("int").alias("id"))


def _word_list(text_col: str, max_length: int) -> Column:
    """The first ``max_length`` lower-cased words of a text; a null text has none."""
    return F.coalesce(F.slice(F.regexp_extract_all(F.lower(text_col), F.lit(TERM_TOKEN), F.lit(0)), 1, max_length),
                      F.array().cast("array<string>"))


def _padded(lists: pa.Array, tokens: pa.Array, ids: np.ndarray, max_length: int) -> tuple[pa.Array, pa.Array]:
    """Word ids and mask of each list of words, as lists of ``max_length`` numbers."""
    at = pc.index_in(lists.flatten(), value_set=tokens).fill_null(-1).to_numpy(zero_copy_only=False)
    real = np.arange(max_length) < pc.list_value_length(lists).to_numpy(zero_copy_only=False)[:, None]
    out = np.full(real.shape, PAD_ID, np.int32)
    out[real] = np.where(at < 0, UNK_ID, ids[at]) if len(ids) else UNK_ID
    offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * max_length)
    as_lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.int32), pa.int32()))
    return as_lists(out), as_lists(real)


def encoded(df: DataFrame, id_col: str, text_cols: list[str], vocab: DataFrame, max_length: int,
            vocab_size: int | None = None) -> DataFrame:
    """(id, {text}_ids, {text}_mask of each text column), one row per row of
    ``df``, whatever its id, each list of length ``max_length``.

    A vocabulary that the caller has bounded (``vocab_size`` up to
    ``MAX_VOCAB_ROW``) is sent to the tasks once and looked up in the row, all
    columns in one pass and without an exchange; any other meets the words in a
    join, where rows are told apart by a number of their own."""
    lists = df.select(F.col(id_col), *[_word_list(c, max_length).alias(c) for c in text_cols])
    names = [f"{c}_{kind}" for c in text_cols for kind in ("ids", "mask")]
    if vocab_size is not None and vocab_size <= MAX_VOCAB_ROW:
        known = vocab.select("token", F.col("id").cast("int").alias("id")).limit(vocab_size + 1).collect()
        if len(known) > vocab_size:
            raise ValueError(f"the vocabulary has more than vocab_size={vocab_size} tokens")
        held = df.sparkSession.sparkContext.broadcast(([r["token"] for r in known], [r["id"] for r in known]))

        def run(batches):
            tokens, ids = pa.array(held.value[0], pa.string()), np.array(held.value[1], np.int32)
            for b in batches:
                cols = [x for k in range(len(text_cols)) for x in _padded(b.column(k + 1), tokens, ids, max_length)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, *names])

        ship_package(df.sparkSession)
        kinds = ", ".join(f"`{n}` array<int>" for n in names)
        return lists.mapInArrow(run, f"`{id_col}` {lists.schema[0].dataType.simpleString()}, {kinds}")
    v = checked_broadcast(vocab.select("token", F.col("id").alias("_tid")), MAX_VOCAB_BROADCAST, known_max=vocab_size)
    path = scratch_path(df.sparkSession, "word-lists")       # the rows' numbers must not change between reads
    lists.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    words = rows.select("_row", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("ws")) for k, c in enumerate(text_cols)])).alias("c"))
    found = (words.select("_row", "c.k", F.posexplode("c.ws").alias("_pos", "token")).join(v, "token", "left")
             .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("k", "_pos", F.coalesce("_tid", F.lit(UNK_ID)).alias("i")))).alias("_s")))
    out = rows.select("_row", id_col).join(found, "_row", "left")
    cols = []
    for k, c in enumerate(text_cols):
        place = F.lit(k)
        real = F.transform(F.filter("_s", lambda x: x["k"] == place), lambda x: x["i"])  # noqa: B023 - called at once
        real = F.coalesce(real, F.array().cast("array<int>"))
        pad = F.lit(max_length) - F.size(real)
        cols += [F.concat(real, F.array_repeat(F.lit(PAD_ID), pad)).alias(f"{c}_ids"),
                 F.concat(F.array_repeat(F.lit(1), F.size(real)), F.array_repeat(F.lit(0), pad)).alias(f"{c}_mask")]
    return out.select(id_col, *cols)


def tokenize_pad(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, max_length: int,
                 prefix: str = "", vocab_size: int | None = None) -> DataFrame:
    """M04 + J10: (id, {prefix}input_ids, {prefix}attention_mask), each of length
    ``max_length``: word ids (unknown -> 1) truncated, then right-padded with
    the end-of-text id 0; mask 1 for words, 0 for padding."""
    e = encoded(df, id_col, [text_col], vocab, max_length, vocab_size)
    return e.select(id_col, F.col(f"{text_col}_ids").alias(f"{prefix}input_ids"), F.col(f"{text_col}_mask").alias(f"{prefix}attention_mask"))


def label_pairs(pairs: DataFrame, id_col: str, vocab: DataFrame, max_length: int = 128,
                vocab_size: int | None = None) -> DataFrame:
    """Question tokens as inputs, answer token ids as labels."""
    return encoded(pairs, id_col, ["question", "answer"], vocab, max_length, vocab_size).select(
        id_col, F.col("question_ids").alias("input_ids"), F.col("question_mask").alias("attention_mask"), F.col("answer_ids").alias("labels"))


def qa_triples(pages: DataFrame, title_col: str = "title", summary_col: str = "summary") -> DataFrame:
    """M07 + P13 + F08 + L07: (context, question, answer) for pages with a
    non-empty summary; answer = text before the first '.'."""
    p = pages.where(F.length(summary_col) > 0)
    return p.select(F.col(summary_col).alias("context"), question_template(title_col).alias("question"),
                    first_sentence(summary_col).alias("answer"))


def topic_corpus(titles: DataFrame, corpus: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """M08 + J04 + S16: texts of the listed titles; missing titles drop out.
    A left-semi join; the planner broadcasts the title list by its bytes."""
    t = titles.select(title_col).distinct()
    return corpus.join(t, title_col, "left_semi").select(title_col, text_col)


def split_check(split_df: DataFrame, key: Column) -> DataFrame:
    """(n, n_train, n_eval, n_overlap, n_union) - the splits must be
    disjoint and together complete."""
    k = split_df.select(key.alias("k"), (F.col("split") == "train").cast("int").alias("t"),
                        (F.col("split") == "eval").cast("int").alias("e"))
    per_key = k.groupBy("k").agg(F.sum("t").alias("ct"), F.sum("e").alias("ce"))
    return per_key.agg(
        F.sum(F.col("ct") + F.col("ce")).cast("long").alias("n"),
        F.sum("ct").cast("long").alias("n_train"), F.sum("ce").cast("long").alias("n_eval"),
        F.count(F.when((F.col("ct") > 0) & (F.col("ce") > 0), 1)).cast("long").alias("n_overlap"),
        F.count("*").cast("long").alias("n_union"))
