"""Office formats without extra libraries (S06 xlsx, S07 docx).

Both are zip archives of XML parts; each file is parsed by a per-file
pandas function over ``binaryFile`` rows, so the work is spread over tasks
file by file.  Readers return long forms that Spark then types and orders:
  * xlsx -> (path, row_no, cells map<header, value>) for the first sheet;
  * docx -> (path, para_no, text) for the body paragraphs.
Small writers are included for round-trip tests and fixtures.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, text_batches
from .files import _infer_types, apply_types, raw_files

NS_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
NS_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
NS_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def xlsx_rows(data: bytes) -> list[list[str | None]]:
    """Cell texts of the first worksheet, row by row (shared strings resolved)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{NS_MAIN}t")))
        sheets = sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
        first = "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in sheets else sheets[0]
        root = ET.fromstring(z.read(first))
    rows = []
    for row in root.iter(f"{NS_MAIN}row"):
        cells: dict[int, str | None] = {}
        for c in row.iter(f"{NS_MAIN}c"):
            idx = _col_index(c.get("r", "A1"))
            t = c.get("t")
            v = c.find(f"{NS_MAIN}v")
            if t == "s" and v is not None:
                cells[idx] = shared[int(v.text)]
            elif t == "inlineStr":
                cells[idx] = "".join(x.text or "" for x in c.iter(f"{NS_MAIN}t"))
            else:
                cells[idx] = v.text if v is not None else None
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


def _xlsx_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows = xlsx_rows(bytes(content))
            except Exception as e:  # noqa: BLE001 - error as value
                out.append((path, None, None, f"{type(e).__name__}: {e}"))
                continue
            if not rows:
                continue
            header = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(rows[0])]
            for i, r in enumerate(rows[1:]):
                out.append((path, i, {h: (r[j] if j < len(r) else None) for j, h in enumerate(header)}, None))
        yield pd.DataFrame(out, columns=["path", "row_no", "cells", "error"])


XLSX_ROWS_SCHEMA = "path string, row_no int, cells map<string,string>, error string"


def scan_xlsx(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """First sheet of each workbook, first row = header, types inferred; a
    workbook that does not parse is one row with its ``error``."""
    ship_package(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInPandas(_xlsx_batches, XLSX_ROWS_SCHEMA)
    keys = [r["k"] for r in rows.select(F.explode(F.map_keys("cells")).alias("k")).distinct().collect()]
    wide = rows.select("path", "row_no", *[F.col("cells")[k].alias(k) for k in sorted(keys)], "error")
    return apply_types(wide, _infer_types(wide, sorted(keys))) if infer else wide


def docx_paragraphs(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{NS_W}body")
    paras = []
    for p in (body if body is not None else root).findall(f"{NS_W}p"):
        parts = []
        for node in p.iter():
            if node.tag == f"{NS_W}t":
                parts.append(node.text or "")
            elif node.tag == f"{NS_W}tab":
                parts.append("\t")
            elif node.tag in (f"{NS_W}br", f"{NS_W}cr"):
                parts.append("\n")
        paras.append("".join(parts))
    return paras


def _docx_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                paras = docx_paragraphs(bytes(content))
            except Exception as e:  # noqa: BLE001
                out.append((path, None, None, f"{type(e).__name__}: {e}"))
                continue
            out.extend((path, i, t, None) for i, t in enumerate(paras))
        yield pd.DataFrame(out, columns=["path", "para_no", "text", "error"])


def scan_docx_paragraphs(spark: SparkSession, path: str | DataFrame, suffix: str | None = None) -> DataFrame:
    """S07 (long form): (path, para_no, text, error)."""
    text_batches(spark)
    folder = isinstance(path, str) and suffix is None
    raw = (spark.read.format("binaryFile").load(path) if folder else raw_files(spark, path, suffix)).select("path", "content")
    return raw.mapInPandas(_docx_batches, "path string, para_no int, text string, error string")


def scan_docx(spark: SparkSession, path: str | DataFrame, suffix: str | None = None) -> DataFrame:
    """(path, text, error) with body paragraphs joined by newlines (A15); a
    file that does not parse has its ``error`` and no text."""
    from ..operators.relational import ordered_concat
    paras = scan_docx_paragraphs(spark, path, suffix)
    good = ordered_concat(paras.where(F.col("error").isNull()), ["path"], "para_no", "text", "\n")
    bad = paras.where(F.col("error").isNotNull()).select("path", "error")
    return good.unionByName(bad, allowMissingColumns=True)


# ------------------------------------------------------------------ writers
def xlsx_bytes(header: list[str], rows: list[list]) -> bytes:
    """Minimal single-sheet workbook with inline strings and numbers."""
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def col(i):
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    body = []
    for r, values in enumerate([header] + rows, start=1):
        body.append(f'<row r="{r}">' + "".join(cell(f"{col(i)}{r}", v) for i, v in enumerate(values)) + "</row>")
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/'
             'spreadsheetml/2006/main"><sheetData>' + "".join(body) + "</sheetData></worksheet>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/'
                   'package/2006/content-types"/>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/'
                   'spreadsheetml/2006/main"><sheets><sheet name="Sheet1" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return buf.getvalue()


def docx_bytes(paragraphs: list[str]) -> bytes:
    """Minimal document with one run per paragraph."""
    ps = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    doc = ('<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/'
           f'wordprocessingml/2006/main"><w:body>{ps}</w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/'
                   'package/2006/content-types"/>')
        z.writestr("word/document.xml", doc)
    return buf.getvalue()


def rendered_files(df: DataFrame, render, suffix: str) -> DataFrame:
    """Files as rows (path, content) for a pack: ``render(pdf)`` returns a list of
    (name, bytes) per Arrow batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(f"{name}{suffix}", data) for name, data in render(pdf)], columns=["path", "content"])
    text_batches(df.sparkSession)
    return df.mapInPandas(run, "path string, content binary")


def write_partition_files(df: DataFrame, out_dir: str, render, suffix: str) -> DataFrame:
    """Write files from executors: ``render(pdf)`` returns a list of
    (name, bytes) per Arrow batch; yields (name, path) rows.  ``out_dir`` is
    any URI pyarrow can open (shared storage on a cluster)."""
    from pyarrow import fs as pafs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = pafs.FileSystem.from_uri(out_dir if "://" in out_dir else "file://" + out_dir)
        filesystem.create_dir(root, recursive=True)
        for pdf in batches:
            written = []
            for name, data in render(pdf):
                p = f"{root}/{name}{suffix}"
                with filesystem.open_output_stream(p) as fh:
                    fh.write(data)
                written.append((name, p))
            yield pd.DataFrame(written, columns=["name", "path"])
    ship_package(df.sparkSession)
    return df.mapInPandas(run, "name string, path string")
