"""Quoted CSV by blocks, and profiles of every table of a folder by (file, column)."""

import csv
import io
import os
import random

import numpy as np
import pandas as pd
import pytest

from tessera.operators.fileprofile import profile_cells, table_texts
from tessera.plans.documents import folder_report, text_report
from tessera.sources import office as O
from tessera.sources import tables as X


def _write(path, name, data: bytes):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "wb") as fh:
        fh.write(data)


def _csv(rows, end="\r\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if "".join(r).strip()]
    head = rows[0]
    return sorted((n, head[i], v) for n, r in enumerate(rows[1:]) if len(r) <= len(head) for i, v in enumerate(r) if v)


def read(spark, path, name):
    got = {}
    for r in X.csv_cells(spark, path).collect():
        if r.path.endswith(name):
            got.setdefault((r.block, r.row_no), []).append((r.column_name, r.value))
    return sorted((n, c, v) for n, k in enumerate(sorted(got)) for c, v in got[k])


def test_quoted_breaks_over_many_blocks(spark, tmpdir_path, small_blocks):
    rng = random.Random(3)
    piece = lambda: rng.choice(["plain", 'say ""no""', 'a "quoted" word', "two\nlines", "x,y", "\n\n", '"', "é日", "line " * 40, "", "a\r\nb"])
    rows = [["id", "a", "b"]] + [[str(k), "".join(piece() for _ in range(rng.randint(0, 5))), piece()] for k in range(600)]
    rows.insert(300, ["long", "word\n" * 4000, "a cell over several blocks"])
    texts = {"q.csv": _csv(rows), "unix.csv": _csv(rows[:200], "\n"), "plain.csv": _csv([["n", "m"]] + [[k, k * 2] for k in range(1500)]), "head.csv": "a,b\n"}
    for name, t in texts.items():
        _write(tmpdir_path, name, t.encode())
    lines = X._lines(spark, tmpdir_path, ".csv")
    assert lines.select("path", "block").distinct().count() > 10
    for name, t in texts.items():
        assert read(spark, tmpdir_path, name) == cells(t), name


def test_odd_files(spark, tmpdir_path):
    _write(tmpdir_path, "a.csv", b'a,b,c\n1,x,2.5\n2,y\n3,z,1.5,EXTRA\n\n4,,\n"6","u,v",3\n')
    _write(tmpdir_path, "b.CSV", "a,a,\n7,café,1\n".encode("iso-8859-1"))
    _write(tmpdir_path, "open.csv", b'a,b\n1,"never closed\n2,x\n')
    _write(tmpdir_path, "empty.csv", b"")
    _write(tmpdir_path, "bom.csv", "﻿k,v\n1,2\n".encode())
    assert read(spark, tmpdir_path, "a.csv") == [(0, "a", "1"), (0, "b", "x"), (0, "c", "2.5"), (1, "a", "2"), (1, "b", "y"),
                                                 (2, "a", "4"), (3, "a", "6"), (3, "b", "u,v"), (3, "c", "3")]
    assert read(spark, tmpdir_path, "b.CSV") == [(0, "Unnamed: 2", "1"), (0, "a", "7"), (0, "a.1", "café")]
    assert read(spark, tmpdir_path, "open.csv") == [(0, "a", "1"), (0, "b", "never closed"), (1, "a", "2"), (1, "b", "x")]
    assert read(spark, tmpdir_path, "bom.csv") == [(0, "k", "1"), (0, "v", "2")] and read(spark, tmpdir_path, "empty.csv") == []


def test_profiles_equal_pandas(spark, tmpdir_path):
    rng = np.random.default_rng(5)
    frames = {f"t{k}.csv": pd.DataFrame({"n": rng.integers(-50, 50, 400 + k), "x": rng.normal(size=400 + k).round(3),
                                         "s": rng.choice(list("abc"), 400 + k)}) for k in range(3)}
    for name, f in frames.items():
        _write(tmpdir_path, name, f.to_csv(index=False).encode())
    got = {(os.path.basename(r.path), r.column_name): r for r in profile_cells(X.csv_cells(spark, tmpdir_path)).collect()}
    assert len(got) == 9
    for name, f in frames.items():
        for c, kind in (("n", "int64"), ("x", "float64")):
            d, r = f[c].describe(), got[name, c]
            assert r.data_type == kind and r["count"] == d["count"] and r.top is None
            assert np.allclose([r["mean"], r["std"], r["min"], r.p25, r.p50, r.p75, r["max"]], d[1:], atol=1e-6)
        n = f["s"].value_counts()
        r = got[name, "s"]
        assert (r.data_type, r["count"], r.n_unique, r.freq, r["mean"]) == ("object", len(f), n.size, n.max(), None)
        assert r.top == min(n.index[n == n.max()])


def test_report_of_a_mixed_folder(spark, tmpdir_path):
    _write(tmpdir_path, "a.txt", b"A very good day. It was great!")
    _write(tmpdir_path, "bad.txt", b"\xff\xfe")
    _write(tmpdir_path, "b.csv", b'k,word\n1,great\n2,"not good, at all"\n')
    _write(tmpdir_path + "/sub", "lines.json", b'{"k": 1, "deep": {"x": 2}}\n{"k": 2.5}\nno object\n')
    _write(tmpdir_path + "/sub", "array.json", b'[{"k": 1},\n {"k": 4, "z": null}]')
    _write(tmpdir_path, "r.xml", b"<rows><i><a>1</a></i><i><a>2</a></i></rows>")
    _write(tmpdir_path, "broken.xml", b"<rows>")
    _write(tmpdir_path, "t.xlsx", O.xlsx_bytes(["k", "name"], [[1, "a"], [2, "b c"]]))
    _write(tmpdir_path, "none.csv", b"a,b\n")
    _write(tmpdir_path, "e.xyz", b"?")
    out = folder_report(spark, tmpdir_path).collect()
    got = {os.path.basename(r.path): r for r in out}
    assert len(out) == len(got) == 10
    shown = lambda n: [(c["name"], c.data_type, c["count"]) for c in got[n].profile]
    assert shown("b.csv") == [("k", "int64", 2), ("word", "object", 2)]
    assert shown("lines.json") == [("k", "float64", 2), ("deep", "object", 1)]
    assert shown("array.json") == [("k", "int64", 2)] and shown("r.xml") == [("a", "int64", 2)]
    assert shown("t.xlsx") == [("k", "int64", 2), ("name", "object", 2)] and shown("none.csv") == [] == shown("broken.xml")
    want = text_report(spark.createDataFrame([(1, "1 great 2 not good, at all")], "doc_id long, text string")).first().asDict()
    assert {k: got["b.csv"][k] for k in want if k != "doc_id"} == {k: v for k, v in want.items() if k != "doc_id"}
    assert got["t.xlsx"].word_count == 5 and got["a.txt"].profile is None and got["a.txt"].compound > 0
    assert got["bad.txt"].error and got["e.xyz"].error and got["b.csv"].error is None


def test_head_of_a_long_table(spark, tmpdir_path):
    rows = [["a", "b"]] + [["w" * (1 + k % 3), str(k)] for k in range(900)]
    _write(tmpdir_path, "t.csv", _csv(rows, "\n").encode())
    r = table_texts(X.csv_cells(spark, tmpdir_path)).first()
    assert r.text == " ".join(" ".join(x) for x in rows[1:])[:1024] and r.word_count == 1800
