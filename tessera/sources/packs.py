"""Packs: many small files kept as rows of Parquet.

A file for each document or conversation costs a listing, an opening and a task's
share of its own, however short it is.  A pack holds their bytes as rows
``(path, part, content, suffix)``; the readers of this package take such a table
in place of a folder.  ``part`` is null where the row is the whole file; a file of
lines may be cut behind line ends into rows of about ``PART_BYTES``, in the order
of ``part``, so that no file has to fit a row or a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import text_batches

PACK = "path string, part long, content binary, suffix string"
#: Suffixes whose files have a folder of their own in a pack, so that a reader of one reads no others.
OWN = (".txt", ".docx", ".csv", ".json", ".xml", ".xlsx")
#: Bytes of a part and of a slice of lines that a Python task hands on: with Arrow
#: batches of 1,000 rows a task holds tens of MB.
PART_BYTES, SLICE_BYTES = 64 << 10, 4 << 20


def _own(path) -> F.Column:
    own = F.lit("other")
    for s in OWN:
        own = F.when(F.lower(path).endswith(s), F.lit(s[1:])).otherwise(own)
    return own


def pack_files(files: DataFrame, path: str) -> None:
    """Adds files (path, content, and part where they are cut) to the pack at ``path``."""
    part = F.col("part") if "part" in files.columns else F.lit(None)
    (files.select("path", part.cast("long").alias("part"), "content", _own(F.col("path")).alias("suffix"))
     .write.mode("append").partitionBy("suffix").parquet(path))


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """The files of a pack; a file that was written more than once is there once,
    as in a folder."""
    rows = spark.read.schema(PACK).parquet(path)
    twice = rows.where("part is null").groupBy("path").count().where("count > 1").select("path")
    if not twice.take(1):
        return rows
    return rows.join(twice, "path", "left_anti").unionByName(rows.join(twice, "path").dropDuplicates(["path"]))


def of_suffix(files: DataFrame, suffix: str | None) -> DataFrame:
    if suffix is None:
        return files
    suffix = suffix.lower()
    own = F.col("suffix") == (suffix[1:] if suffix in OWN else "other")
    return files.where(own & F.lower("path").endswith(suffix))


def whole_files(files: DataFrame) -> DataFrame:
    """(path, content) of every file of a pack, one row a file."""
    cut = files.where("part is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("ps"))
    joined = F.array_join(F.transform("ps", lambda p: p["content"].cast("string")), "").cast("binary")
    return files.where("part is null").select("path", "content").unionByName(cut.select("path", joined.alias("content")))


def split_lines(files: DataFrame) -> DataFrame:
    """(path, part, _id, value): the lines of a pack's files, numbered from 0 in
    their part; a file's last line need not end with a line feed."""
    text_batches(files.sparkSession)
    rows = files.select("path", F.coalesce("part", F.lit(0)).alias("part"), "content")
    lines = rows.mapInArrow(_split, "path string, part long, _id long, value binary")
    return lines.withColumn("value", F.col("value").cast("string"))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int64()), pa.array(lines, pa.binary())],
                                          names=["path", "part", "_id", "value"])
    for b in batches:
        row, no, lines, size = [], [], [], 0
        for k, content in enumerate(b.column(2)):
            found = content.as_py().split(b"\n")
            if not found[-1]:
                found.pop()
            row += [k] * len(found)
            no += range(len(found))
            lines += found
            size += len(content.as_buffer())
            if size >= SLICE_BYTES:
                yield rows()
                row, no, lines, size = [], [], [], 0
        if row:
            yield rows()


def pack_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Adds files of lines (path, value, the columns of ``order``) to the pack at
    ``path``: a file's lines in that order, each with a line feed.  Lines are dealt
    out by ranges of (path, order), so a long file is written by many tasks."""
    text_batches(lines.sparkSession)
    sorted_ = lines.repartitionByRange("path", *order).sortWithinPartitions("path", *order)
    rows = sorted_.select("path", F.coalesce("value", F.lit("")).cast("binary").alias("value"))
    pack_files(rows.mapInArrow(_join, "path string, part long, content binary"), path)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 33        # ranges rise with the partition
    path, held, size, done = None, [], 0, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.string()), pa.array([r[1] for r in done], pa.int64()),
                                           pa.array([r[2] for r in done], pa.binary())], names=["path", "part", "content"])
    for b in batches:
        for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held and (p != path or size >= PART_BYTES):
                done.append((path, part, b"".join(held)))
                part, held, size = part + 1, [], 0
            path = p
            held += (v, b"\n")
            size += len(v) + 1
        if done:
            yield rows()
            done = []
    if held:
        done.append((path, part, b"".join(held)))
        yield rows()
