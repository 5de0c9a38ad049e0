"""Packs: files as rows of Parquet read like a folder of them, whatever their number."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.catalog.sources import QUERIES
from tessera.plans.documents import folder_report
from tessera.sources import files as S
from tessera.sources import office as O
from tessera.sources import packs as P
from tessera.sources import tables as X


def _pack(spark, files):
    out = tempfile.mkdtemp(prefix="tessera-pack-")
    P.pack_files(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "path string, content binary"), out)
    return P.read_pack(spark, out)


@pytest.fixture(scope="module")
def tables(spark):
    """600 documents and 600 conversations."""
    sf = tempfile.mkdtemp(prefix="tessera-sf-")
    text = F.concat(F.lit('A "good" day,\nno. '), F.col("id").cast("string"))
    spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"),
                            F.length(text).cast("long").alias("n_chars")).write.parquet(f"{sf}/documents.parquet")
    (spark.range(1200).select(F.floor(F.col("id") / 2).alias("conv_id"), (F.col("id") % 2).cast("int").alias("turn"),
                              F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
     .write.parquet(f"{sf}/conversations.parquet"))
    return sf


@pytest.mark.parametrize("name, folder, rows", [
    ("folder_report", "rt-folder", 2 + 2 + 200), ("read_documents", "rt-mixed", 600), ("scan_docx", "rt-docx", 600),
    ("scan_conversation_lines", "rt-lines", 600), ("table_profiles", "rt-tables", 6 * 5)])
def test_files_do_not_grow_with_rows(spark, tables, monkeypatch, name, folder, rows):
    root = tempfile.mkdtemp(prefix="tessera-root-")
    for module in ("tessera.catalog.sources", "tessera.sources.files", "tessera.sources.tables", "tessera.operators.fileprofile"):
        monkeypatch.setattr(f"{module}.scratch_path", lambda _, n: f"{root}/{n}-{len(os.listdir(root))}")
    if name == "table_profiles":
        monkeypatch.setattr("tessera.catalog.sources.FILE_ROWS", 1)
        rows = 600 * 5
    assert QUERIES[name](spark, tables).count() == rows
    (made,) = [d for d in os.listdir(root) if d.startswith(folder)]
    found = [f for _, _, fs in os.walk(f"{root}/{made}") for f in fs if f.startswith("part-")]
    assert 0 < len(found) <= 80


def test_pack_reads_like_a_folder(spark, tmpdir_path):
    files = [("a.TXT", "héllo\n".encode()), ("bad.txt", b"\xff\xfe"), ("sub/b.docx", O.docx_bytes(["one", "", "two"])), ("broken.docx", b"no zip"),
             ("latin.csv", "n,v\r\n1,café\r\n2,\"x\n\"\"y\"\"\"".encode("iso-8859-1")), ("short.CSV", b"\xef\xbb\xbfa,b\n1\n2,3,4\n5,6\n"),
             ("l.json", b'{"k": 1, "m": [1, 2]}\nnone\n{"k": 2}'), ("arr.json", b'[{"k": "x"},\n {"k": "y"}]'),
             ("t.xml", b"<rows><r><v>7</v></r></rows>"), ("t.xlsx", O.xlsx_bytes(["h"], [[3], [4]])), ("p.pdf", b"x"), ("e.xyz", b"x")]
    for name, data in files:
        os.makedirs(os.path.dirname(f"{tmpdir_path}/{name}"), exist_ok=True)
        with open(f"{tmpdir_path}/{name}", "wb") as fh:
            fh.write(data)
    pack = _pack(spark, [*files, files[0]])                       # written twice: one file
    short = lambda r: {**r.asDict(recursive=True), "path": os.path.basename(r["path"])}
    shown = lambda df: sorted((str(sorted(short(r).items(), key=str)) for r in df.collect()))
    assert shown(S.read_documents(spark, pack)) == shown(S.read_documents(spark, tmpdir_path))
    order = ["path", "column_name", "value"]
    assert shown(X.table_cells(spark, pack).select(*order)) == shown(X.table_cells(spark, tmpdir_path).select(*order))
    assert shown(folder_report(spark, pack)) == shown(folder_report(spark, tmpdir_path))


def test_lines_of_a_long_file_in_parts(spark, tmpdir_path):
    rows = [("long", k, f"line {k} " + "x" * (k % 90)) for k in range(6000)] + [(f"f{k}", 0, "only") for k in range(50)] + [("f7", 1, None)]
    P.pack_lines(spark.createDataFrame(rows, "path string, n long, value string"), ["n"], tmpdir_path + "/p")
    pack = P.read_pack(spark, tmpdir_path + "/p")
    assert pack.where("path = 'long'").count() > 3
    got = sorted((r.path, r.line_no, r.text) for r in S.numbered_lines(spark, pack).collect())
    assert got == sorted((p, n, v or "") for p, n, v in rows)
    (whole,) = P.whole_files(pack.where("path = 'long'")).collect()
    assert bytes(whole.content).decode() == "".join(v + "\n" for p, _, v in rows if p == "long")


def test_quoted_csv_in_parts(spark, tmpdir_path):
    rows = [("t.csv", -1, '"id","text"')] + [("t.csv", k, f'"{k}","a ""quoted"" cell,\nof two lines {"y" * 40}"') for k in range(4000)]
    P.pack_lines(spark.createDataFrame(rows, "path string, n long, value string"), ["n"], tmpdir_path + "/p")
    cells = X.csv_cells(spark, P.read_pack(spark, tmpdir_path + "/p"))
    got = sorted(r.value for r in cells.where("column_name = 'text'").collect())
    assert got == [f'a "quoted" cell,\nof two lines {"y" * 40}'] * 4000
    assert sorted(int(r.value) for r in cells.where("column_name = 'id'").collect()) == list(range(4000))


def test_lines_follow_their_turns(spark):
    """Rows by turn however they lie in the table; one without a turn of its own stays behind the row it came after."""
    sf = tempfile.mkdtemp(prefix="tessera-sf-")
    who = lambda t: "assistant" if t % 2 else "user"
    rows = [(1, t, who(t), f"t{t}") for t in (3, 0, 2, 1)] + [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "r"), (2, 1, "assistant", "a")]
    rows += [(3, 0, "user", "x"), (3, None, "assistant", "y"), (3, 1, "user", "z"), (3, 2, "assistant", "w")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{sf}/conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["scan_conversation_lines"](spark, sf).collect())
    assert got == [(1, "t0", "t1"), (1, "t2", "t3"), (2, "q", "a"), (2, "r", "a"), (3, "x", "y"), (3, "z", "w")]
