"""Tables of a mixed folder as one long frame of cells (S03-S06 for many files).

Every table file below a folder or in a pack, whatever its columns, becomes rows
``(path, block, row_no, position, column_name, value)``: one plan for all
files, so nothing loops over them.  (block, row_no) orders the rows of a file,
``position`` its columns; a missing or empty cell has no row.

CSV files are read by blocks, also where quoted cells hold line breaks: a line
continues a record if the quotes before it in the file are odd in number.  The
quotes of each block are counted in one pass, running sums over the blocks of a
file give the parity at each block's start, and only the record that a block
border cuts is put together afterwards.  A file whose quotes are odd altogether
has no such reading; there each line is a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import _c, ColumnOrName
from ..session import scratch_path, ship_package
from .files import BROADCAST_BLOCKS, XML_ROWS_SCHEMA, _xml_rows, raw_files, suffix_glob
from .office import XLSX_ROWS_SCHEMA, _xlsx_batches
from .packs import of_suffix, split_lines

def _file(path: str | DataFrame) -> Column:
    """The column of a file's path: of a folder as Spark's readers give it, or of a pack."""
    return F.col("path" if isinstance(path, DataFrame) else "_metadata.file_path")


#: One cell behind its comma: quoted (quotes inside are doubled), else up to the next comma.
CSV_CELL = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
CELLS = ["path", "block", "row_no", "position", "column_name", "value"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _small(df: DataFrame) -> DataFrame:
    """A table of blocks or files, broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_BLOCKS else df


def _lines(spark: SparkSession, path: str | DataFrame, suffix: str) -> DataFrame:
    """(path, block, _id, line) of the files of a suffix; ids rise within a block."""
    if isinstance(path, DataFrame):
        return split_lines(of_suffix(path, suffix)).select("path", F.col("part").alias("block"), "_id", F.col("value").alias("line"))
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix_glob(suffix)).option("lineSep", "\n")
    return reader.text(path).select(_file(path).alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                    F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))


def _quotes(line: ColumnOrName) -> Column:
    return F.length(_c(line)) - F.length(F.replace(_c(line), F.lit('"'), F.lit("")))


def csv_records(spark: SparkSession, path: str | DataFrame, suffix: str = ".csv") -> DataFrame:
    """(path, block, row_no, record) of all CSV files below ``path``; blank
    records are left out, files that are not UTF-8 are read as ISO-8859-1.
    The files must not change while they are read (two passes)."""
    lines = _lines(spark, path, suffix)
    blocks = _stored(lines.groupBy("path", "block").agg(
        F.sum(_quotes("line")).alias("quotes"), F.max(_quotes("line") % 2).alias("broken"),
        F.min(F.is_valid_utf8("line").cast("int")).alias("utf8")), "csv-blocks")
    file = Window.partitionBy("path")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    paired = F.sum("quotes").over(file) % 2 == 0
    blocks = _small(blocks.select(
        "path", "block", F.min("utf8").over(file).alias("utf8"),
        F.when(paired, F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).otherwise(0).alias("odd"),
        (paired & (F.col("broken") == 1)).alias("broken"),
        F.when(paired, F.coalesce(F.sum("quotes").over(before), F.lit(0)) + F.col("quotes")).otherwise(0).alias("upto")))
    lines = (lines.join(blocks, ["path", "block"])
             .withColumn("line", F.when(F.col("utf8") == 1, F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))))
    # blocks without a line of odd quotes outside an open record hold one record a line: they are not shuffled
    plain = ~F.col("broken") & (F.col("odd") == 0)
    whole = lines.where(plain).select("path", "block", F.col("_id").alias("row_no"), F.col("line").alias("record"))
    w = Window.partitionBy("path", "block").orderBy("_id")
    earlier = F.coalesce(F.sum(_quotes("line")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = (lines.where(~plain).withColumn("starts", ((F.col("odd") + earlier) % 2 == 0).cast("long"))
              .withColumn("piece", F.sum("starts").over(w))
              .groupBy("path", "block", "piece")
              .agg(F.array_sort(F.collect_list(F.struct("_id", "line"))).alias("ls"), F.max("upto").alias("upto"))
              .select("path", "block", "piece", F.col("ls")[0]["_id"].alias("row_no"), F.col("upto"),
                      F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("record")))
    pieces = _stored(pieces, "csv-pieces")
    last = pieces.groupBy("path", "block").agg(F.max("piece").alias("_last"))
    pieces = pieces.join(last, ["path", "block"]).withColumn(
        "edge", (F.col("piece") == 0) | ((F.col("piece") == F.col("_last")) & (F.col("upto") % 2 == 1)))
    inner = pieces.where(~F.col("edge")).select("path", "block", "row_no", "record")
    # edges, at most two a block: a piece that starts a record and the pieces 0 of the blocks behind it
    record = F.sum((F.col("piece") > 0).cast("long")).over(Window.partitionBy("path").orderBy("block", "piece"))
    cut = (pieces.where("edge").withColumn("_record", record).groupBy("path", "_record")
           .agg(F.array_sort(F.collect_list(F.struct("block", "piece", "row_no", "record"))).alias("ps"))
           .select("path", F.col("ps")[0]["block"].alias("block"), F.col("ps")[0]["row_no"].alias("row_no"),
                   F.array_join(F.transform("ps", lambda x: x["record"]), "\n").alias("record")))
    out = whole.unionByName(inner).unionByName(cut).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return out.where(F.trim("record") != "")


def csv_fields(record: ColumnOrName) -> Column:
    """The cells of a record, quotes taken off and doubled quotes made one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), _c(record)), F.lit(CSV_CELL), 1)
    bare = lambda f: F.replace(F.regexp_replace(f, r'^"|"[^"]*$', ""), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda f: F.when(f.startswith('"'), bare(f)).otherwise(f))


def unique_names(names: ColumnOrName) -> Column:
    """Column names of a header: an empty one is 'Unnamed: i', a repeated one gets '.1', '.2', ..."""
    named = F.transform(_c(names), lambda n, i: F.when(F.trim(n) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(n))
    seen = lambda n, i: F.size(F.filter(F.slice(named, F.lit(1), i), lambda m: m == n))
    return F.transform(named, lambda n, i: F.when(seen(n, i) > 0, F.concat(n, F.lit("."), seen(n, i).cast("string"))).otherwise(n))


def csv_cells(spark: SparkSession, path: str | DataFrame, suffix: str = ".csv") -> DataFrame:
    """S03 for all CSV files of a folder: the first record of a file is its
    header; records with more cells than it are skipped, shorter ones padded."""
    rows = csv_records(spark, path, suffix).select("path", "block", "row_no", csv_fields("record").alias("fields"))
    rows = _stored(rows, "csv-rows")
    first = F.min(F.struct("block", "row_no", "fields"))
    heads = _small(rows.groupBy("path").agg(first.alias("h")).select(
        "path", F.col("h")["block"].alias("_block"), F.col("h")["row_no"].alias("_row"),
        unique_names(F.transform(F.col("h")["fields"], lambda f: F.replace(f, F.lit("﻿"), F.lit("")))).alias("names")))
    body = (rows.join(heads, "path").where("(block, row_no) <> (_block, _row) and size(fields) <= size(names)")
            .select("path", "block", "row_no", F.posexplode(F.arrays_zip("names", "fields")).alias("position", "c")))
    return _present(body.select("path", "block", "row_no", "position", F.col("c")["names"].alias("column_name"),
                                F.col("c")["fields"].alias("value")))


def _present(cells: DataFrame) -> DataFrame:
    return cells.where("value is not null and value <> ''").select(
        "path", F.col("block").cast("long"), F.col("row_no").cast("long"), F.col("position").cast("int"), "column_name", "value")


def _map_cells(rows: DataFrame) -> DataFrame:
    """Cells of (path, block, row_no, cells map) rows, columns in the order of the map."""
    return _present(rows.select("path", "block", "row_no", F.posexplode(F.map_entries("cells")).alias("position", "e"))
                    .select("path", "block", "row_no", "position", F.col("e")["key"].alias("column_name"), F.col("e")["value"].alias("value")))


def json_cells(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """S04 for all JSON files: one object a line, read by blocks, or one array of
    objects a file (its first line begins with '['), read as one row.  Nested
    values are JSON text; lines that are no object have no cells."""
    lines = _lines(spark, path, ".json")
    first = F.min(F.when(F.trim("line") != "", F.struct("block", "_id", F.ltrim("line").startswith("[").alias("a"))))
    forms = _small(_stored(lines.groupBy("path").agg(first["a"].alias("is_array")), "json-forms"))
    each = lines.join(forms, "path").where("not is_array").select(
        "path", "block", F.col("_id").alias("row_no"), F.from_json("line", "map<string,string>").alias("cells"))
    if isinstance(path, DataFrame):              # only files of arrays are put together
        path = path.join(forms.where("is_array"), "path", "left_semi")
    files = raw_files(spark, path, ".json").select(_file(path).alias("path"), F.col("content").cast("string").alias("text"))
    arrays = files.join(forms, "path").where("is_array").select(
        "path", F.lit(0).alias("block"), F.posexplode(F.from_json("text", "array<map<string,string>>")).alias("row_no", "cells"))
    return _map_cells(each.unionByName(arrays))


def table_cells(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """The cells of every csv, json, xml and xlsx file below ``path``.  A map of a
    row that lacks a column shifts positions, so a column's place is its least."""
    ship_package(spark)
    coded = lambda suffix, reader, schema: (raw_files(spark, path, suffix).select(_file(path).alias("path"), "content")
                                            .mapInPandas(reader, schema).where("error is null")
                                            .select("path", F.lit(0).alias("block"), "row_no", "cells"))
    small = coded(".xml", _xml_rows, XML_ROWS_SCHEMA).unionByName(coded(".xlsx", _xlsx_batches, XLSX_ROWS_SCHEMA))
    return csv_cells(spark, path).unionByName(json_cells(spark, path)).unionByName(_map_cells(small))
