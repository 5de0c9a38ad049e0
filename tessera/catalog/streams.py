"""Streaming queries (X01-X03): each runs a Structured Streaming job with
``availableNow`` over files derived from the fixture tables (written in two
batches so the stream sees more than one file), then returns the sink read
back; the oracle is the batch answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import feedback_format
from ..session import scratch_path
from ..sources import feedback as FB
from ..streaming import feedback as X
from .retrieval import FEEDBACK_SQL, feedback_rows


def _log(spark, sf):
    log = scratch_path(spark, "stream-log")
    fb = feedback_rows(spark, sf)
    FB.append_feedback_text(fb.where(F.col("helpful")), log)
    FB.append_feedback_text(fb.where(~F.coalesce(F.col("helpful"), F.lit(False))), log)
    return log


def q_stream_feedback(spark, sf):
    log = _log(spark, sf)
    return X.stream_feedback(spark, log, scratch_path(spark, "stream-fb-out"), scratch_path(spark, "stream-fb-ckpt"))


def q_stream_feedback_growing(spark, sf):
    """Logs of two-line answers that grow twice, cut inside a record: the stream
    runs after each segment and carries the open record."""
    log, out, ckpt = (scratch_path(spark, f"stream-grow-{x}") for x in ("log", "out", "ckpt"))
    fb = feedback_rows(spark, sf).withColumn("answer", F.concat("answer", F.lit("\n"), "question"))
    bucket = F.pmod(F.crc32("question"), F.lit(64)).alias("bucket")
    lines = fb.select(bucket, F.struct("question", "answer", "helpful").alias("entry"),
                      F.posexplode(F.split(F.regexp_replace(feedback_format("question", "answer", "helpful"), "\r", ""), "\n")))
    order = Window.partitionBy("bucket").orderBy("entry", "pos")
    lines = lines.withColumn("no", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    half = F.floor(F.col("n") / 4) * 2 + 1                       # an odd number of lines: inside a record of two
    for segment in (lines.where(F.col("no") <= half), lines.where(F.col("no") > half)):
        (segment.repartition("bucket").sortWithinPartitions("bucket", "no").select("bucket", F.col("col").alias("value"))
         .write.mode("append").partitionBy("bucket").text(log))
        got = X.stream_feedback(spark, log + "/*", out, ckpt)
    return got


def q_stream_feedback_stats(spark, sf):
    log = _log(spark, sf)
    return X.stream_feedback_stats(spark, log, scratch_path(spark, "stream-stats-out"),
                                   scratch_path(spark, "stream-stats-ckpt"))


def q_stream_latest_context(spark, sf):
    src = scratch_path(spark, "stream-conv")
    c = spark.read.parquet(f"{sf.rstrip('/')}/conversations.parquet")
    # two arrivals: early turns first, later turns second (last writer must win across files)
    c.where(F.col("turn") < 2).write.parquet(src + "/a")
    c.where(F.col("turn") >= 2).write.parquet(src + "/b")
    return X.stream_latest_context(spark, src + "/*", c.schema, "conv_id", "text", "turn",
                                   scratch_path(spark, "stream-ctx-out"), scratch_path(spark, "stream-ctx-ckpt"),
                                   where="role = 'assistant'")


QUERIES = {
    "stream_feedback": q_stream_feedback,
    "stream_feedback_growing": q_stream_feedback_growing,
    "stream_feedback_stats": q_stream_feedback_stats,
    "stream_latest_context": q_stream_latest_context,
}

SQL = {
    "stream_feedback": f"WITH {FEEDBACK_SQL} SELECT question, answer, helpful FROM fb",
    "stream_feedback_growing": f"WITH {FEEDBACK_SQL} SELECT question, answer || chr(10) || question AS answer, helpful FROM fb",
    "stream_feedback_stats": f"WITH {FEEDBACK_SQL} SELECT helpful, count(*)::BIGINT AS n FROM fb GROUP BY helpful",
    "stream_latest_context": "SELECT conv_id, arg_max(text, turn) AS context FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
}
