"""Structured Streaming jobs.

All three run with ``trigger(availableNow=True)`` against a checkpoint on
shared storage, so a restarted job resumes exactly where it stopped and an
executor loss only replays the current micro-batch.

* X01 feedback log -> parsed, structured entries (parquet file sink).  A log is
  a folder that segments of whole lines are added to.  Lines are cut and parsed
  where they are read; a record that is still open at the end of a micro-batch
  waits in the stream's state, one text per log, and goes on with the lines that
  come next.
* X02 running entries-per-flag counts over the entries of X01.
* X03 latest context per key (one row of state per key; with no event time there
  is no watermark, so state grows with the number of keys - documented).

X02 and X03 run in update mode: a micro-batch writes only the keys it changed,
to a folder of its own (``epoch=N``).  A replayed batch writes the same folder
again, nothing that is being read is overwritten, and a reader takes each key's
row of the last epoch (``latest_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.feedback import feedback_stats, join_edges, log_lines, log_pieces, parse_pieces


def _run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _carry(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Edges of one log in a micro-batch, behind the record that was left open."""
    held = state.get[0] if state.exists else None
    done, rest = join_edges(held, pd.concat(list(frames)), False)
    if rest is not None:
        state.update((rest,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame({"text": done})


def _entries(spark: SparkSession, log_dir: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.option("lineSep", "\n")
    source = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).text(log_dir)
    log = F.regexp_replace(F.col("_metadata")["file_path"], "/[^/]*$", "")
    pieces = log_pieces(log_lines(source, log))
    carried = pieces.where("edge").groupBy("log").applyInPandasWithState(
        _carry, "text string", "held string", "append", "NoTimeout")
    return parse_pieces(pieces.where("not edge").select("text").unionByName(carried))


def stream_log(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str, max_files: int | None = None) -> DataFrame:
    """X01 with both outputs: (question, answer, helpful, malformed).  A record
    that is open at the end is in neither until a later run sees its end."""
    _run(_entries(spark, log_dir, max_files).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return spark.read.parquet(out_dir)


def stream_feedback(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str, max_files: int | None = None) -> DataFrame:
    """New lines of the log are parsed (multi-line answers kept) and
    appended to ``out_dir``; returns the records of the sink as a table."""
    return stream_log(spark, log_dir, out_dir, checkpoint, max_files).where("malformed is null").drop("malformed")


def _changes(out_dir: str):
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
    return write


def latest_rows(spark: SparkSession, out_dir: str, *keys: str) -> DataFrame:
    """The row of each key in its last epoch."""
    rows = spark.read.parquet(out_dir)
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


def stream_feedback_stats(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str) -> DataFrame:
    """Running counts per helpful flag, equal to the batch A16.  The
    entries are a stream of their own (``<checkpoint>/entries``)."""
    entries = stream_log(spark, log_dir, f"{checkpoint}/entries/rows", f"{checkpoint}/entries/checkpoint")
    source = spark.readStream.schema(entries.schema).parquet(f"{checkpoint}/entries/rows")
    stats = feedback_stats(source.where("malformed is null"))
    _run(stats.writeStream.outputMode("update").foreachBatch(_changes(out_dir))
         .option("checkpointLocation", f"{checkpoint}/stats"))
    return latest_rows(spark, out_dir, "helpful")


def stream_latest_context(spark: SparkSession, src_dir: str, schema: T.StructType | str, key: str,
                          text_col: str, version_col: str, out_dir: str, checkpoint: str,
                          where: str | None = None) -> DataFrame:
    """Last text per key over a growing set of parquet files."""
    src = spark.readStream.schema(schema).parquet(src_dir)
    if where:
        src = src.where(where)
    latest = src.groupBy(key).agg(F.max_by(text_col, version_col).alias("context"))
    _run(latest.writeStream.outputMode("update").foreachBatch(_changes(out_dir))
         .option("checkpointLocation", checkpoint))
    return latest_rows(spark, out_dir, key)
