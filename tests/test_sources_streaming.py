"""Cards C1 (CSV), C2 (XML), JSON flattening, C8 (feedback log), office files,
and batch == stream for X01-X03."""

import os

from pyspark.sql import functions as F

from tessera.sources import feedback as FB
from tessera.sources import files as S
from tessera.sources import office as O
from tessera.streaming import feedback as X


def _write(path, name, data: bytes):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "wb") as fh:
        fh.write(data)


def test_csv_bad_lines_and_encoding(spark, tmpdir_path):
    _write(tmpdir_path, "a.csv", b'a,b,c\n1,x,2.5\n2,y\n3,z,1.5,EXTRA\n4,,\n"6","u,v",3\n')
    _write(tmpdir_path, "b.csv", "a,b,c\n7,café,1\n".encode("iso-8859-1"))
    rows = sorted(S.scan_csv(spark, tmpdir_path).collect(), key=lambda r: r["a"])
    assert [r["a"] for r in rows] == [1, 2, 4, 6, 7]              # the row with an extra field is skipped
    by = {r["a"]: r for r in rows}
    assert by[2]["c"] is None and by[4]["b"] is None and by[4]["c"] is None
    assert by[6]["b"] == "u,v" and by[1]["c"] == 2.5
    assert by[7]["b"] == "café"                                   # ISO-8859-1 file decoded per file
    types = dict(S.scan_csv(spark, tmpdir_path).dtypes)
    assert types == {"a": "bigint", "b": "string", "c": "double"}


def test_csv_files_with_other_column_orders_and_quoted_breaks(spark, tmpdir_path):
    _write(tmpdir_path, "a.csv", b'a,b\n1,"two\nlines"\n')
    _write(tmpdir_path, "b.csv", b"b,a\nx,2\n")
    _write(tmpdir_path, "c.csv", b"b,c\ny,9\n")
    got = sorted(((r["a"], r["b"], r["c"]) for r in S.scan_csv(spark, tmpdir_path).collect()), key=str)
    assert got == [(1, "two\nlines", None), (2, "x", None), (None, "y", 9)]


def test_broken_files_leave_an_error(spark, tmpdir_path):
    for kind, read in (("xml", S.scan_xml_rows), ("xlsx", O.scan_xlsx), ("docx", O.scan_docx)):
        _write(f"{tmpdir_path}/{kind}", f"bad.{kind}", b"<rows><a>")
        (r,) = read(spark, f"{tmpdir_path}/{kind}").collect()
        assert r["error"] and r["path"].endswith(f"bad.{kind}")
    _write(tmpdir_path + "/mixed", "a.xml", b"<rows><a><b>1</b></a></rows>")
    _write(tmpdir_path + "/mixed", "z.xml", b"<rows><a>")
    rows = S.scan_xml_rows(spark, tmpdir_path + "/mixed").collect()
    assert sorted((r["b"], r["error"] is None) for r in rows if r["b"]) == [(1, True)] and len(rows) == 2


def test_line_escapes(spark):
    texts = ["plain", "two\nlines", "back\\slash", "a literal \\n stays", "\\\n\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", S.escape_line("t").alias("e"), S.unescape_line(S.escape_line("t")).alias("u")).collect()
    assert all(r["u"] == r["t"] and "\n" not in r["e"] for r in rows)


def test_malformed_feedback_is_kept(spark, tmpdir_path):
    _write(tmpdir_path, "f.log", (LOG + "no record at all\nQuestion: x, Answer: cut").encode())
    files = spark.read.text(tmpdir_path, wholetext=True)
    assert sorted(r["line"] for r in FB.malformed_feedback(files).collect()) == ["Question: x, Answer: cut", "no record at all"]


def test_xml_rows_card(spark, tmpdir_path):
    _write(tmpdir_path, "r.xml", b'<rows><item id="1"><a>1</a><b>x</b><a>9</a></item>'
                                 b'<other><a>2</a><c><d>z</d></c></other></rows>')
    rows = sorted(S.scan_xml_rows(spark, tmpdir_path).collect(), key=lambda r: r["row_no"])
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [(9, "x", None), (2, None, None)]


def test_json_flatten(spark, tmpdir_path):
    _write(tmpdir_path, "j.json", b'[{"a":1,"b":{"c":2,"d":{"e":[1,2]}}},{"a":2,"b":{"c":null}}]')
    df = S.scan_json_flat(spark, tmpdir_path, multi_line=True)
    assert sorted(df.columns) == ["a", "b.c", "b.d.e"]
    rows = sorted(df.collect(), key=lambda r: r["a"])
    assert rows[0]["b.d.e"] == [1, 2] and rows[1]["b.c"] is None


def test_route_by_suffix(spark):
    df = spark.createDataFrame([("X.PDF",), ("y.csv",), ("z.md",), ("p.JPEG",)], "path string")
    out = {r["path"]: r for r in S.route_by_suffix(df).collect()}
    assert out["X.PDF"]["type"] == "text" and out["y.csv"]["type"] == "dataframe"
    assert out["z.md"]["error"] == S.UNSUPPORTED and out["p.JPEG"]["reader"] == "image"


def test_office_round_trip(spark, tmpdir_path):
    _write(tmpdir_path + "/x", "t.xlsx", O.xlsx_bytes(["k", "name", "v"], [[1, "a", 1.5], [2, "b & c", None]]))
    x = sorted(O.scan_xlsx(spark, tmpdir_path + "/x").collect(), key=lambda r: r["k"])
    assert [(r["k"], r["name"], r["v"]) for r in x] == [(1, "a", 1.5), (2, "b & c", None)]
    _write(tmpdir_path + "/d", "t.docx", O.docx_bytes(["First para", "", "Third <para>"]))
    d = O.scan_docx(spark, tmpdir_path + "/d").first()
    assert d["text"] == "First para\n\nThird <para>"


def test_mixed_folder(spark, tmpdir_path):
    _write(tmpdir_path, "a.TXT", "héllo".encode())
    _write(tmpdir_path, "bad.txt", b"\xff\xfe")
    _write(tmpdir_path + "/sub", "b.docx", O.docx_bytes(["one", "two"]))
    _write(tmpdir_path + "/sub", "broken.docx", b"no zip")
    for name in ("c.csv", "d.pdf", "e.xyz"):
        _write(tmpdir_path, name, b"x,y")
    got = {os.path.basename(r["path"]): (r["type"], r["text"], r["error"]) for r in S.read_documents(spark, tmpdir_path).collect()}
    assert got["a.TXT"] == ("text", "héllo", None) and got["b.docx"] == ("text", "one\ntwo", None)
    assert got["bad.txt"][1] is None and got["bad.txt"][2] and got["broken.docx"][1] is None and got["broken.docx"][2]
    assert got["c.csv"] == ("dataframe", None, None) and got["d.pdf"] == ("text", None, S.NO_DECODER)
    assert got["e.xyz"] == (None, None, S.UNSUPPORTED) and len(got) == 7


def test_text_strict_utf8(spark, tmpdir_path):
    _write(tmpdir_path, "ok.txt", "héllo\n".encode())
    _write(tmpdir_path, "bad.txt", b"\xff\xfe bad")
    out = {os.path.basename(r["path"]): r for r in S.scan_text(spark, tmpdir_path).collect()}
    assert out["ok.txt"]["text"] == "héllo\n" and out["ok.txt"]["error"] is None
    assert out["bad.txt"]["text"] is None and out["bad.txt"]["error"]


LOG = ("Feedback Log\n"
       "Question: q1, Answer: a, with, commas, Helpful: False\n"
       "Question: q2, Answer: line one\nline two, Helpful: True\n"
       "Question: q3, Answer: x, Helpful: None\n"
       "Question: , Answer: empty question, Helpful: False\n")


def test_feedback_log_parse(spark, tmpdir_path):
    _write(tmpdir_path, "feedback.log", LOG.encode())
    rows = sorted(FB.read_feedback_log(spark, tmpdir_path).collect(), key=lambda r: r["answer"])
    got = [(r["question"], r["answer"], r["helpful"]) for r in rows]
    assert got == [("q1", "a, with, commas", False), ("", "empty question", False),
                   ("q2", "line one\nline two", True), ("q3", "x", None)]
    lines = spark.read.text(tmpdir_path)
    recs, bad = FB.parse_feedback_lines(lines)
    assert recs.count() == 3 and bad.count() == 2                 # the two-line record is reported, not dropped


def test_streams_equal_batch(spark, tmpdir_path):
    log = tmpdir_path + "/log"
    _write(log, "1.log", LOG.encode())
    _write(log, "2.log", b"Question: q9, Answer: z, Helpful: True\n")
    batch = FB.read_feedback_log(spark, log)
    streamed = X.stream_feedback(spark, log, tmpdir_path + "/out", tmpdir_path + "/ck1")
    assert sorted(map(tuple, streamed.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    stats = X.stream_feedback_stats(spark, log, tmpdir_path + "/st", tmpdir_path + "/ck2")
    assert sorted(map(tuple, stats.collect()), key=str) == sorted(map(tuple, FB.feedback_stats(batch).collect()), key=str)
    conv = spark.createDataFrame([(1, 0, "a"), (1, 3, "c"), (2, 1, "x")], "k long, v long, t string")
    conv.where("v < 2").write.parquet(tmpdir_path + "/c/a")
    conv.where("v >= 2").write.parquet(tmpdir_path + "/c/b")
    latest = X.stream_latest_context(spark, tmpdir_path + "/c/*", conv.schema, "k", "t", "v",
                                     tmpdir_path + "/lc", tmpdir_path + "/ck3")
    assert {r["k"]: r["context"] for r in latest.collect()} == {1: "c", 2: "x"}


MIXED = ("Feedback Log\nno record\nQuestion: a, Answer: b, Helpful: True\nQuestion: two\nlines, Answer: x\n\ny, Helpful: False\r\n"
         "tail, Helpful: True\nQuestion: open, Helpful: True\nQuestion: in it, Answer: z, Helpful: None\nstray\n"
         "Question: m, Answer: 1\n2\n3, Helpful: False\nQuestion: m2, Answer: Question: 4\nQuestion: 5, Answer: 6\n7, Helpful: True\n")


def _whole(spark, path):
    """The log parsed as one text per file, by the pattern alone."""
    files = spark.read.text(path, wholetext=True)
    return (sorted(map(tuple, FB.parse_feedback_text(files).drop("entry_no").collect()), key=str),
            sorted(r["line"] for r in FB.malformed_feedback(files).collect()))


def _entries(df):
    return (sorted((tuple(r[:3]) for r in df.collect() if r["malformed"] is None), key=str),
            sorted(r["malformed"] for r in df.collect() if r["malformed"] is not None))


def test_log_blocks_equal_the_whole_file(spark, tmpdir_path):
    _write(tmpdir_path, "a.log", (MIXED * 40 + "Question: left open, Answer: at the end\n").encode())
    expected = _whole(spark, tmpdir_path)
    assert len(expected[0]) == 200 and any("left open" in x for x in expected[1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128", "777", "1m"):                          # blocks that begin inside records
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert _entries(FB.read_log_entries(spark, tmpdir_path)) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_record_goes_on_in_the_next_micro_batch(spark, tmpdir_path):
    log, out, ck = (tmpdir_path + x for x in ("/log", "/out", "/ck"))
    lines = MIXED.splitlines(keepends=True)
    for i, line in enumerate(lines):                               # one segment a line, several runs
        _write(log, f"{i:03d}.log", line.encode())
        os.utime(f"{log}/{i:03d}.log", (1_700_000_000 + i, 1_700_000_000 + i))
        if i in (3, 4, 11, len(lines) - 1):
            got = X.stream_log(spark, log, out, ck, max_files=3)
            so_far = tmpdir_path + f"/whole{i}"
            _write(so_far, "all.log", "".join(lines[:i + 1]).encode())
            assert _entries(got)[0] == _whole(spark, so_far)[0]
    assert _entries(got) == _whole(spark, so_far)


def test_snapshots_write_changed_keys_only(spark, tmpdir_path):
    src, out, ck = (tmpdir_path + x for x in ("/src", "/out", "/ck"))
    rows = lambda *r: spark.createDataFrame(r, "k long, v long, t string").write.mode("append").parquet(src)
    rows((1, 0, "a"), (2, 0, "b"))
    X.stream_latest_context(spark, src, "k long, v long, t string", "k", "t", "v", out, ck)
    rows((2, 5, "c"))
    got = X.stream_latest_context(spark, src, "k long, v long, t string", "k", "t", "v", out, ck)
    assert {r["k"]: r["context"] for r in got.collect()} == {1: "a", 2: "c"}
    written = {(r["epoch"], r["k"]) for r in spark.read.parquet(out).collect()}
    assert written == {(0, 1), (0, 2), (1, 2)}
    X._changes(out)(spark.createDataFrame([(2, "c")], "k long, context string"), 1)      # a replayed batch
    assert {r["k"]: r["context"] for r in X.latest_rows(spark, out, "k").collect()} == {1: "a", 2: "c"}


def test_line_numbers_of_split_files_equal_the_whole_file(spark, tmpdir_path):
    files = {"a.txt": "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(3000)), "b.txt": "one\r\n\nthree, no end", "empty.txt": "",
             "c.txt": "é\n" * 500}
    for name, text in files.items():
        _write(tmpdir_path, name, text.encode())
    want = sorted((name, i, x) for name, text in files.items() if text
                  for i, x in enumerate((text[:-1] if text.endswith("\n") else text).split("\n")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, tasks in (("3000", 20), ("1m", 1)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = S.numbered_lines(spark, tmpdir_path)
            assert lines.rdd.getNumPartitions() >= tasks
            assert sorted((os.path.basename(r["path"]), r["line_no"], r["text"]) for r in lines.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
