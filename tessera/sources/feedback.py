"""Feedback log.

Entries are ``Question: q, Answer: a, Helpful: b`` lines under a
``Feedback Log`` header.  A question or answer may span lines (the whole
response area is sent), so a record can lie across file blocks, files of a
segmented log, and micro-batches of a stream.

Where a record may begin is decided by the lines before, but some lines settle
it whatever came before: one that holds ', Answer: ' and ends with the flag,
and the first line ending with the flag after one that begins a question and
its answer.  Each task cuts its file blocks behind such lines (``log_pieces``):
all from a block's first to its last cut is parsed where it lies, by one
regular expression.  Only what stands before the first cut and behind the last
one (its edges, a few lines) goes on, in the order of the log, to the task or
the stream's state that puts the edges together (``join_edges``).  Files are
read as lines, so a large log is many tasks.

Lines end with a line feed, a carriage return before it is skipped.  Non-empty
lines that are in no record are the ``malformed`` output.  The structured
(parquet) log is the primary sink.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import feedback_format
from ..session import ship_package

HEADER = "Feedback Log"
FLAG = r", Helpful: (True|False|None)\r?$"
RECORD = r"(?dms)^Question: (.*?), Answer: (.*?)" + FLAG
LINE = r"^Question: (.*?), Answer: (.*), Helpful: (True|False|None)$"
FEEDBACK_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("helpful", T.BooleanType()),
])
PIECES = "log string, time timestamp, file string, start long, place long, edge boolean, ended boolean, text string"


def _helpful(c):
    return F.when(c == "True", F.lit(True)).when(c == "False", F.lit(False))


def _records(v: Column) -> Column:
    """Array of (q, a, h) of the records of a text."""
    q, a, h = (F.regexp_extract_all(v, F.lit(RECORD), F.lit(i)) for i in (1, 2, 3))
    return F.arrays_zip(q.alias("q"), a.alias("a"), h.alias("h"))


def _malformed(v: Column) -> Column:
    """Array of the non-empty lines of a text that are in no record."""
    lines = F.transform(F.split(F.regexp_replace(v, RECORD, ""), "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    return F.filter(lines, lambda x: (F.trim(x) != "") & (x != HEADER))


def parse_feedback_text(files: DataFrame, value_col: str = "value") -> DataFrame:
    """S11 over rows of whole texts: (question, answer, helpful, entry_no)."""
    z = files.select(F.posexplode(_records(F.col(value_col))).alias("entry_no", "r"))
    return z.select(F.col("r.q").alias("question"), F.col("r.a").alias("answer"),
                    _helpful(F.col("r.h")).alias("helpful"), F.col("entry_no").cast("long").alias("entry_no"))


def malformed_feedback(files: DataFrame, value_col: str = "value") -> DataFrame:
    """S11 over rows of whole texts: the non-empty lines that are in no record."""
    return files.select(F.explode(_malformed(F.col(value_col))).alias("line"))


def parse_pieces(pieces: DataFrame) -> DataFrame:
    """Records (malformed null) and malformed lines (the rest null) of the
    texts of ``log_pieces``: (question, answer, helpful, malformed)."""
    v, none = F.col("text"), F.lit(None).cast("string")
    good = F.transform(_records(v), lambda r: F.struct(r["q"].alias("question"), r["a"].alias("answer"),
                                                       _helpful(r["h"]).alias("helpful"), none.alias("malformed")))
    bad = F.transform(_malformed(v), lambda x: F.struct(none.alias("question"), none.alias("answer"),
                                                        F.lit(None).cast("boolean").alias("helpful"), x.alias("malformed")))
    return pieces.select(F.explode(F.concat(good, bad)).alias("r")).select("r.*")


def log_lines(source: DataFrame, log: Column) -> DataFrame:
    """Lines of a text source (batch or stream, ``lineSep`` a line feed) with
    their place and the properties that decide where a log can be cut."""
    v, m = F.col("value"), F.col("_metadata")
    return source.select(
        log.alias("log"), m["file_modification_time"].alias("time"), m["file_path"].alias("file"),
        m["file_block_start"].alias("start"), v.alias("text"), v.rlike(r"(?ds), Answer: .*" + FLAG).alias("full"),
        v.rlike("(?d)" + FLAG).alias("closes"), v.rlike(r"(?ds)^Question: .*, Answer: ").alias("opens"))


def _cut_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of a task, in file order, to pieces: per block the lines up to the
    first cut and those behind the last one as edges, the others as they come."""
    block, open_lines, opened, cut_before, place = None, [], False, False, 0

    def row(texts, edge, ended):
        return (*block, place, edge, ended, "\n".join(texts))

    def frame_of(rows):
        return pd.DataFrame(rows, columns=["log", "time", "file", "start", "place", "edge", "ended", "text"])

    for frame in frames:
        rows = []
        if len(frame):
            moved = (frame["file"].ne(frame["file"].shift()) | frame["start"].ne(frame["start"].shift())).to_numpy()
            bounds = [*np.flatnonzero(moved), len(frame)]
            for a, b in zip(bounds, bounds[1:]):
                part = frame.iloc[a:b]
                here = tuple(part[["log", "time", "file", "start"]].iloc[0])
                if here != block:
                    if open_lines:
                        rows.append(row(open_lines, True, False))
                    block, open_lines, opened, cut_before, place = here, [], False, False, 0
                texts, closes, full = part["text"].tolist(), part["closes"].to_numpy(), part["full"].to_numpy()
                at = np.arange(len(part))
                last = lambda mask, first: np.r_[first, np.maximum.accumulate(np.where(mask, at, -2))[:-1]]
                opening = part["opens"].to_numpy() & ~closes
                # the first closing line behind an opening one
                fresh = np.maximum(last(opening, -1 if opened else -2), -1 if opened else -2) > last(closes, -2)
                cuts = np.flatnonzero(full | (closes & fresh))
                opened_at, closed_at = (np.flatnonzero(x)[-1] if x.any() else -1 for x in (opening, closes))
                opened = bool(opened_at > closed_at) if max(opened_at, closed_at) >= 0 else opened
                done = 0
                if len(cuts) and not cut_before:
                    done = cuts[0] + 1
                    rows.append(row(open_lines + texts[:done], True, True))
                    open_lines, cut_before, place = [], True, place + 1
                if len(cuts) and cuts[-1] + 1 > done:
                    rows.append(row(open_lines + texts[done:cuts[-1] + 1], False, True))
                    open_lines, place, done = [], place + 1, cuts[-1] + 1
                open_lines += texts[done:]
        yield frame_of(rows)
    if open_lines:
        yield frame_of([row(open_lines, True, False)])


def log_pieces(lines: DataFrame) -> DataFrame:
    """Pieces (``PIECES``) of a log's lines; no record lies across pieces that
    are not edges."""
    ship_package(lines.sparkSession)
    return lines.mapInPandas(_cut_blocks, PIECES)


_PY_RECORD = re.compile(r"(?ms)^Question: (.*?), Answer: (.*?), Helpful: (True|False|None)\r?$")
_PY_START = re.compile(r"(?m)^Question: ")


def join_edges(held: str | None, edges: pd.DataFrame, last: bool) -> tuple[list[str], str | None]:
    """Texts that are complete after these edges of one log, and the rest that
    is held until more lines come (a record that has begun); ``last``: nothing
    comes any more, so nothing is held."""
    done, held = [], [] if held is None else [held]
    for text, ended in edges.sort_values(["time", "file", "start", "place"])[["text", "ended"]].itertuples(index=False):
        held.append(text)
        if ended:
            done.append("\n".join(held))
            held = []
    rest = "\n".join(held) if held else None
    if rest is not None and not last:
        end = 0
        for found in _PY_RECORD.finditer(rest):
            end = found.end()
        start = _PY_START.search(rest, end)
        keep = len(rest) if start is None else start.start()
        if keep:
            done.append(rest[:keep])
        rest = rest[keep:] or None
    elif rest is not None:
        done, rest = done + [rest], None
    return done, rest


def _join_batch(edges: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"text": join_edges(None, edges, True)[0]})


def read_log_entries(spark: SparkSession, path: str, log: Column | None = None) -> DataFrame:
    """S11 batch: (question, answer, helpful, malformed) of every log file; with
    ``log``, a column over the ``_metadata`` of the files, all files of one value
    are segments of one log, by time and name, and records go across them."""
    source = spark.read.option("lineSep", "\n").text(path)
    pieces = log_pieces(log_lines(source, F.col("_metadata")["file_path"] if log is None else log))
    edges = pieces.where("edge").groupBy("log").applyInPandas(_join_batch, "text string")
    return parse_pieces(pieces.where("not edge").select("text").unionByName(edges))


def read_feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """S11 batch: every record of every log file (multi-line answers kept)."""
    return read_log_entries(spark, path).where("malformed is null").drop("malformed")


def parse_feedback_lines(lines: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """S11 line mode: (records, malformed) - the header line is skipped."""
    v = F.col(value_col)
    ok = v.rlike(LINE)
    recs = lines.where(ok).select(F.regexp_extract(v, LINE, 1).alias("question"),
                                  F.regexp_extract(v, LINE, 2).alias("answer"),
                                  _helpful(F.regexp_extract(v, LINE, 3)).alias("helpful"))
    bad = lines.where(~ok & (v != HEADER) & (v != "")).select(v.alias("line"))
    return recs, bad


def format_feedback(df: DataFrame) -> DataFrame:
    """(value) log lines."""
    return df.select(feedback_format("question", "answer", "helpful").alias("value"))


def append_feedback_text(df: DataFrame, path: str) -> None:
    """S12 text form: append one log line per entry (readers accept files with
    or without the header line)."""
    format_feedback(df).write.mode("append").text(path)


def append_feedback(df: DataFrame, path: str) -> None:
    """S12 structured form (primary): append (question, answer, helpful) as parquet."""
    df.select("question", "answer", "helpful").write.mode("append").parquet(path)


def feedback_stats(df: DataFrame) -> DataFrame:
    """Entries per helpful flag (True / False / None)."""
    return df.groupBy("helpful").agg(F.count("*").cast("long").alias("n"))
