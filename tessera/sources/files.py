"""File readers and writers.

Files are the unit the original reads (one upload = one file), so the
readers work per file but never gather a whole table anywhere: typed tabular
formats use Spark's own scans (CSV / JSON / XML), raw formats use
``binaryFile`` plus a per-file pandas parser (``mapInPandas``).

Where a reader's ``path`` may be a table, it is a pack of files (``packs``) in
place of a folder.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _c, ColumnOrName, word_count
from ..session import scratch_path, ship_package
from .packs import of_suffix, split_lines, whole_files

# File suffix -> (reader, envelope type); anything else is an error.
SUFFIX_READERS = [
    (".pdf", "pdf", "text"),
    (".xlsx", "xlsx", "dataframe"),
    (".csv", "csv", "dataframe"),
    (".json", "json", "dataframe"),
    (".xml", "xml", "dataframe"),
    (".docx", "docx", "text"),
    (".jpg", "image", "image"),
    (".jpeg", "image", "image"),
    (".png", "image", "image"),
    (".dcm", "dicom", "dicom"),
    (".txt", "txt", "text"),
]
UNSUPPORTED = "Unsupported document type."


def route_by_suffix(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds (reader, type, error) from the lower-cased file name suffix."""
    p = F.lower(F.col(path_col))
    reader = F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for suffix, rd, ty in reversed(SUFFIX_READERS):
        reader = F.when(p.endswith(suffix), F.lit(rd)).otherwise(reader)
        kind = F.when(p.endswith(suffix), F.lit(ty)).otherwise(kind)
    return df.withColumn("reader", reader).withColumn("type", kind).withColumn(
        "error", F.when(reader.isNull(), F.lit(UNSUPPORTED)))


def suffix_glob(suffix: str) -> str:
    """File-name pattern of a suffix in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def raw_files(spark: SparkSession, path: str | DataFrame, suffix: str | None = None) -> DataFrame:
    """Files below ``path`` or of a pack (of one suffix) as ``binaryFile`` rows; a
    column that is not used, the content included, is not read."""
    if isinstance(path, DataFrame):
        return whole_files(of_suffix(path, suffix))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader if suffix is None else reader.option("pathGlobFilter", suffix_glob(suffix))).load(path)


#: Types whose content has no text here: bytes of images, scans and page layouts.
NO_DECODER = "No text decoder for this type."


def read_documents(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """S01 over a mixed folder or pack: one envelope (path, type, text, error) per file.

    Text and docx files are read; tables (csv, json, xml, xlsx) are envelopes
    of type 'dataframe' without text, to be opened with their own scan; other
    known types carry ``NO_DECODER`` and unknown ones ``UNSUPPORTED``.  Every
    file of the folder that has a byte has exactly one row, broken ones with their
    error (Spark does not list files without a byte; a pack does)."""
    from .office import scan_docx
    listed = route_by_suffix(raw_files(spark, path).select("path"))
    none = F.lit(None).cast("string")
    read = (scan_text(spark, path, suffix=".txt").withColumn("type", F.lit("text"))
            .unionByName(scan_docx(spark, path, suffix=".docx").withColumn("type", F.lit("text"))))
    error = F.when(F.col("reader").isin("pdf", "image", "dicom"), F.lit(NO_DECODER)).otherwise(F.col("error"))
    rest = listed.where("reader is null or reader not in ('txt', 'docx')").select("path", "type", none.alias("text"), error.alias("error"))
    return read.select("path", "type", "text", "error").unionByName(rest)


def scan_text(spark: SparkSession, path: str | DataFrame, strict: bool = True, suffix: str | None = None,
              lines: bool = False) -> DataFrame:
    """(path, text, error) per file; with ``strict`` a file that is not
    valid UTF-8 yields an error value instead of text.  With ``lines``, for files
    of any size: a row for every line without its line feed, with the bytes of the
    file and of the line, a large file read by as many tasks as it has blocks
    (``text_totals`` puts a file's counts together)."""
    if lines:
        return _text_lines(spark, path, strict, suffix)
    folder = isinstance(path, str) and suffix is None
    raw = spark.read.format("binaryFile").load(path) if folder else raw_files(spark, path, suffix)
    s = F.col("content").cast("string")
    ok = F.is_valid_utf8(s)
    if not strict:
        return raw.select("path", F.make_valid_utf8(s).alias("text"), F.lit(None).cast("string").alias("error"))
    return raw.select("path", F.when(ok, s).alias("text"),
                      F.when(~ok, F.lit("'utf-8' codec can't decode the file")).alias("error"))


def _text_lines(spark: SparkSession, path: str, strict: bool, suffix: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n")
    if suffix is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", suffix_glob(suffix))
    ok = F.is_valid_utf8("value") if strict else F.lit(True)
    return reader.text(path).select(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"),
        F.when(ok, F.col("value") if strict else F.make_valid_utf8("value")).alias("text"),
        F.when(~ok, F.lit("'utf-8' codec can't decode the file")).alias("error"),
        F.col("_metadata.file_size").alias("file_bytes"), (F.octet_length("value") + 1).cast("long").alias("line_bytes"))


def text_totals(lines: DataFrame) -> DataFrame:
    """A01 by file of ``scan_text``'s lines: (path, n_chars, word_count, error) of
    every file's whole text; counts are null where it is not valid UTF-8."""
    found = lines.groupBy("path").agg(
        F.sum(F.length("text").cast("long") + 1).alias("n"), F.sum(word_count("text")).alias("w"), F.max("error").alias("error"),
        (F.max("file_bytes") - F.sum("line_bytes")).alias("over"))
    # the bytes of all lines and line feeds are the file's, less those of a mark at its start (3, one
    # sign of the text), which the reader drops; without a last line feed they are one more
    chars = F.col("n") + F.when(F.col("over") >= 2, 1).otherwise(0) - F.when(F.col("over").isin(-1, 2), 1).otherwise(0)
    ok = F.col("error").isNull()
    return found.select("path", F.when(ok, chars).alias("n_chars"), F.when(ok, F.col("w")).alias("word_count"), "error")


def _infer_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Per column: bigint if every non-empty value casts to a long, else
    double, else string - one aggregate over all columns (result bounded by
    the number of columns)."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        present = v.isNotNull() & (v != "")
        aggs += [F.count(F.when(present, 1)).alias(f"n{i}"),
                 F.count(F.when(present & v.rlike(r"^[+-]?[0-9]+$") &
                                F.expr(f"try_cast(`{c}` as bigint)").isNotNull(), 1)).alias(f"l{i}"),
                 F.count(F.when(present & F.expr(f"try_cast(`{c}` as double)").isNotNull(), 1)).alias(f"d{i}")]
    row = df.agg(*aggs).first() if aggs else None
    out = {}
    for i, c in enumerate(columns):
        n, nl, nd = row[f"n{i}"], row[f"l{i}"], row[f"d{i}"]
        out[c] = "bigint" if n > 0 and nl == n else ("double" if n > 0 and nd == n else "string")
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cols = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        t = types.get(c, "string")
        if t == "string":
            cols.append(v.alias(c))
        else:
            cols.append(F.expr(f"try_cast(nullif(`{c}`, '') as {t})").alias(c))
    return df.select(*cols)


def _file_forms(spark: SparkSession, path: str) -> DataFrame:
    """(file, utf8, head): whether a file is valid UTF-8, and its first line
    (the first row of the block that starts the file)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("n"))
    return lines.groupBy("file").agg(F.min(F.is_valid_utf8("value").cast("int")).alias("utf8"),
                                     F.min(F.when(F.col("start") == 0, F.struct("n", "value")))["value"].alias("head"))


def scan_csv(spark: SparkSession, path: str, infer: bool = True, encoding: str | None = None,
             multi_line: bool = True) -> DataFrame:
    """Header + inferred types; rows with **more** fields than the header
    are skipped, rows with fewer are padded with nulls; a file that is not
    valid UTF-8 is read as ISO-8859-1 (decided per file).

    Files are grouped by header line and encoding (the driver holds their
    listing anyway), each group is read by its own header and the groups are
    united by column name.  ``multi_line`` keeps line breaks inside quotes;
    without it large files are split.

    Rule: read n+1 string columns; the extra column is non-null only for
    rows that have too many fields."""
    groups: dict[tuple, list[str]] = {}
    for r in _file_forms(spark, path).collect():             # a file listing: one row per file
        code = encoding or ("UTF-8" if r["utf8"] == 1 else "ISO-8859-1")
        groups.setdefault((r["head"], code), []).append(r["file"])
    parts = []
    for (_, code), files in sorted(groups.items(), key=lambda g: min(g[1])):
        reader = spark.read.option("header", True).option("encoding", code)
        header = reader.csv(files[0]).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_extra"]])
        rows = (reader.schema(schema).option("mode", "PERMISSIVE").option("nullValue", "\u0001").option("emptyValue", "")
                .option("multiLine", multi_line).option("enforceSchema", True).csv(files))
        parts.append(rows.where(F.col("_extra").isNull()).drop("_extra"))
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return apply_types(rows, _infer_types(rows, rows.columns)) if infer else rows


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> dotted top-level columns (arrays left as they are)."""
    cols = []

    def walk(prefix: list[str], dt: T.DataType):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(prefix + [f.name], f.dataType)
        else:
            ref = F.col(".".join(f"`{p}`" for p in prefix))
            cols.append(ref.alias(sep.join(prefix)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(*cols)


def scan_json_flat(spark: SparkSession, path: str, multi_line: bool = False,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """JSON (an array / object per file with ``multi_line``, else JSON
    lines) -> rows with nested objects flattened to dotted names."""
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return flatten(r.json(path))


def _xml_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                root = ET.fromstring(bytes(content))
            except ET.ParseError as e:
                out.append((path, None, None, f"XML parse error: {e}"))
                continue
            for i, elem in enumerate(root):
                cells = {}
                for child in elem:  # duplicate tags: the last one wins
                    cells[child.tag] = child.text
                out.append((path, i, cells, None))
        yield pd.DataFrame(out, columns=["path", "row_no", "cells", "error"])


XML_ROWS_SCHEMA = "path string, row_no int, cells map<string,string>, error string"


def scan_xml_rows(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """S05 for small files whose rows have no common tag: each child of the
    root is a row, each grandchild tag a column holding its direct text (null
    for element-only cells); attributes are ignored.  A file that does not
    parse is one row with its ``error``.  Where the row tag is known, use
    ``scan_xml_tagged``."""
    ship_package(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInPandas(_xml_rows, XML_ROWS_SCHEMA)
    keys = [r["k"] for r in rows.select(F.explode(F.map_keys("cells")).alias("k")).distinct().orderBy("k").collect()]
    wide = rows.select("path", "row_no", *[F.col("cells")[k].alias(k) for k in keys], "error")
    if not infer:
        return wide
    return apply_types(wide, _infer_types(wide, keys))


def scan_xml_tagged(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """S05 with a known row tag: Spark's XML source, attributes excluded,
    repeated tags (arrays) reduced to their last element; a row that does not
    parse has its text in ``error``."""
    df = (spark.read.format("xml").option("rowTag", row_tag).option("excludeAttribute", True)
          .option("columnNameOfCorruptRecord", "_corrupt_record").load(path))
    cols = [F.element_at(F.col(f.name), -1).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema.fields if f.name != "_corrupt_record"]
    bad = F.col("_corrupt_record") if "_corrupt_record" in df.columns else F.lit(None).cast("string")
    return df.select(*cols, bad.alias("error"))


def escape_line(c: ColumnOrName) -> F.Column:
    """One line for a text: backslashes doubled, line breaks as \\n."""
    return F.replace(F.replace(_c(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_line(c: ColumnOrName) -> F.Column:
    parts = F.transform(F.split(_c(c), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


#: Rows of the table of file blocks that are broadcast at most (three values each).
BROADCAST_BLOCKS = 1_000_000


def numbered_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """S02/S15 line by line: (path, line_no from 0, text) of all files, a large
    file read by as many tasks as it has blocks.

    A task reads a block's lines one after another, so a line's place in its
    block is the distance of row ids to the block's first.  The lines of each
    block are counted in a pass without texts, and running sums over the blocks
    of a file give each block's first line number.  Lines end with a line feed;
    an empty file has no lines.  The files must not change in between."""
    if isinstance(path, DataFrame):
        return _numbered_pack(path)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    staged = scratch_path(spark, "line-blocks")
    lines.groupBy("path", "_start").agg(F.count("*").alias("n"), F.min("_id").alias("_first")).write.parquet(staged)
    blocks = spark.read.parquet(staged)
    few = blocks.count() <= BROADCAST_BLOCKS
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "_start", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return (lines.join(F.broadcast(blocks) if few else blocks, ["path", "_start"])
            .select("path", (F.col("_base") + F.col("_id") - F.col("_first")).cast("long").alias("line_no"), "text"))


def _numbered_pack(files: DataFrame) -> DataFrame:
    """``numbered_lines`` of a pack: a line's place in its part is known, and only
    files that are cut into parts need sums over them."""
    spark, lines = files.sparkSession, split_lines(files)
    cut = files.where("part is not null").groupBy("path").count().where("count > 1").select("path")
    if not cut.take(1):
        return lines.select("path", F.col("_id").alias("line_no"), F.col("value").alias("text"))
    staged = scratch_path(spark, "line-parts")
    split_lines(files.join(cut, "path", "left_semi")).groupBy("path", "part").agg(F.count("*").alias("n")).write.parquet(staged)
    parts = spark.read.parquet(staged)
    few = parts.count() <= BROADCAST_BLOCKS
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("path", "part", F.sum("n").over(before).alias("_base"))
    return (lines.join(F.broadcast(parts) if few else parts, ["path", "part"], "left")
            .select("path", (F.coalesce("_base", F.lit(0)) + F.col("_id")).alias("line_no"), F.col("value").alias("text")))


def scan_conversation_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Headerless one-column files of prefixed lines, read as text (a
    comma never splits a line).  Each file is one ordered sequence:
    (path, line_no, text).  A turn is one line; line breaks inside it are
    written by ``escape_line``."""
    return numbered_lines(spark, path)


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write records as JSON lines (one object per line; a documented
    deviation from one JSON array per file, which cannot be split)."""
    df.write.mode(mode).json(path)
    return path


def load_json_dataset(spark: SparkSession, path: str, schema: T.StructType | str,
                      multi_line: bool = False) -> DataFrame:
    """JSON records with an explicit schema (no inference pass)."""
    return spark.read.option("multiLine", multi_line).schema(schema).json(path)


def path_value(path_col: str, key: str) -> F.Column:
    """Value of a ``key=value`` directory in a partitioned path."""
    return F.regexp_extract(_c(path_col), f"{key}=([^/]+)", 1)
