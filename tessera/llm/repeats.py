"""Repeated byte strings by depth-limited most-significant-digit radix passes.

Two suffixes belong together when their first ``depth`` bytes agree, so
suffixes are ordered only through that depth and equal groups of the last
pass are exactly the repeated windows:

* digit 1: the window's anchor, its least hashed ``gram`` (leftmost on ties).
  Equal windows have equal anchors at equal offsets, and neighbouring windows
  mostly share one, so a *run* of windows with one anchor is one row (about
  one for every ``(depth - gram) / 2`` bytes).  Anchors that occur once leave.
* digit 2: the content of the whole run.  A group whose runs are all equal is
  finished: each of its windows is repeated.
* next digits, only for groups that still differ: one run of each content is cut
  into blocks of 64 windows, at the same distances from the anchor in every run.
  All windows of a block hold the same middle bytes (137 of 200), its digit: a
  block alone with its digit holds no repeated window and leaves.  A block that
  is whole in several runs is finished as one range.  Of what still differs one
  block of each content is cut again, into blocks of 16, 4 and 1.

So a passage in very many texts costs a few ranges a run, each pass keeps only
groups that are still tied, and every group is met by partial aggregation and by
joins that adaptive execution splits; no group is listed in a task.  Texts are
exchanged by document, and only runs that differ carry their bytes.

Removed is each byte covered by a string of ``depth`` bytes that also starts
anywhere else, the same document included; strings are judged on the input
and never cross documents.  Null texts count as empty; texts shorter than
``depth`` have no window; rows are treated one by one (a repeated row is a
copy of the other, whatever its id); a null id stays null; other columns are
not looked at.  Strings are compared by 64-bit hashes within an anchor's
64-bit hash; rows that share an id are told apart by a 64-bit hash of their text
(equal rows have equal results).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import PIECE, _pows, constants, mix, slices, utf8
from .tables import ready, staged

DEPTH, GRAM, RADIX = 200, 32, 4
OUTPUT = 8 << 20                              # bytes of a batch of runs
_BYTE = constants(256, 41)
_INDEX = 21                                  # bits of a place in a piece
RUNS = "doc_id {id}, part long, anchor long, content long, first long, n int, lead int"


def pieces(off: np.ndarray, depth: int):
    """(byte range, row range, window starts that count) of bounded size: whole
    rows, or overlapping parts of a long one."""
    n, row = len(off) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, side="right")) - 1)
        lo, hi = int(off[row]), int(off[end])
        if hi - lo <= PIECE:
            yield lo, hi, row, end
        else:
            step = PIECE - depth
            for a in range(lo, max(lo + 1, hi - depth + 1), step):
                yield a, min(hi, a + step + depth - 1), row, row + 1
        row = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    pw, _ = _pows(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:len(data)], out=c[1:])
    return c


def window_hash(c: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    _, ipw = _pows(len(c))
    return mix((c[start + length] - c[start]) * ipw[start])


def window_runs(data: np.ndarray, off: np.ndarray, depth: int, gram: int):
    """Runs of neighbouring windows with one anchor: (row, anchor hash, content
    hash, first start in the row, windows, anchor's distance from the start)."""
    w = depth - gram + 1
    out = []
    for lo, hi, r0, r1 in pieces(off, depth):
        m = hi - lo
        if m < depth:
            continue
        c = prefix_hash(data[lo:hi])
        g = window_hash(c, np.arange(m - gram + 1), gram)
        key = (g >> np.uint64(_INDEX) << np.uint64(_INDEX)) | np.arange(len(g), dtype=np.uint64)
        pad = -len(key) % w
        blocks = np.append(key, np.full(pad, np.iinfo(np.uint64).max)).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = m - depth + 1
        anchor = (np.minimum(back[:starts], ahead[w - 1:w - 1 + starts]) & np.uint64((1 << _INDEX) - 1)).astype(np.int64)
        ends = np.minimum(off[r0 + 1:r1 + 1], hi) - lo
        begins = np.maximum(off[r0:r1], lo) - lo
        count = np.maximum(ends - begins - depth + 1, 0)
        row = np.repeat(np.arange(r0, r1), count)
        s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins, count)
        if not len(s):
            continue
        a = anchor[s]
        head = np.ones(len(s), bool)
        head[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(head)
        n = np.diff(np.append(first, len(s)))
        s0, a0, rw = s[first], a[first], row[first]
        lead = a0 - s0
        content = mix(window_hash(c, s0, n - 1 + depth) + lead.astype(np.uint64) * _BYTE[0] + n.astype(np.uint64) * _BYTE[1])
        out.append((rw, g[a0], content, s0 + lo - off[rw], n, lead))
    if not out:
        return [np.zeros(0, np.int64)] * 6
    return [np.concatenate(x) for x in zip(*out)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, text): ``part`` tells apart rows that share an id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def _with_texts(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """Rows joined with per-row results, one exchange of texts for all uses."""
    more = more.withColumnsRenamed({"doc_id": "__id", "part": "__part"})
    return rows.join(more, rows["doc_id"].eqNullSafe(more["__id"]) & (rows["part"] == more["__part"]), how)


def repeated_spans(rows: DataFrame, depth: int, gram: int) -> DataFrame:
    """(doc_id, part, lo, hi): byte ranges covered by repeated windows."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = RUNS.format(id=id_type)

    def find(batches):
        for b in slices(batches, 2):
            data, off = utf8(b.column(2))
            row, anchor, content, first, n, lead = window_runs(data, off, depth, gram)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(anchor.view(np.int64), pa.int64()),
                 pa.array(content.view(np.int64), pa.int64()), pa.array(first, pa.int64()),
                 pa.array(n.astype(np.int32), pa.int32()), pa.array(lead.astype(np.int32), pa.int32())],
                names=["doc_id", "part", "anchor", "content", "first", "n", "lead"])

    runs = rows.mapInArrow(find, schema)
    tied = (runs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi"))
            .where("c > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("alike")))
    held = staged(runs.join(staged(tied, "tied"), "anchor"), "runs")
    kinds = (held.where("not alike").groupBy("anchor", "content")
             .agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "part", "first", "n", "lead")).alias("one")))
    kinds = staged(kinds, "kinds")        # tables of their own: joins with them can be split at hot keys
    covered = lambda df: df.select("doc_id", "part", F.col("first").alias("lo"),
                                   (F.col("first") + F.col("n") - 1 + depth).alias("hi"))
    alike = covered(held.where("alike")).unionByName(covered(
        held.where("not alike").join(kinds.where("c > 1").select("anchor", "content"), ["anchor", "content"])))
    # an anchor all of whose contents are covered has nothing left to find
    open_ = kinds.groupBy("anchor").agg(F.min("c").alias("least")).where("least = 1").select("anchor")
    pieces = staged(spelled(rows, kinds.join(open_, "anchor", "left_semi"), depth, id_type), "pieces", "zstd")
    size = 1
    while size * RADIX < depth - gram + 1:
        size *= RADIX
    found = [alike]
    while size:
        blocks = staged(pieces.mapInArrow(cutter(size, depth), BLOCKS.format(id=id_type)), "blocks", "zstd")
        done, pieces = tie(blocks, depth)
        found.append(done)
        size //= RADIX
        if not size or pieces.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


PIECES = "anchor long, doc_id {id}, part long, lo long, n int, lead int, known boolean, bytes binary"
BLOCKS = "anchor long, place int, digit long, content long, doc_id {id}, part long, lo long, n int, lead int, known boolean, bytes binary"


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """``data[start:start + length]`` for each pair, as a binary array."""
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
    off = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data[at])])


def spelled(rows: DataFrame, kinds: DataFrame, depth: int, id_type: str) -> DataFrame:
    """One run of each content with its bytes; ``known`` if the content occurs
    more than once, so that its windows are covered already."""
    by_text = kinds.groupBy("one.doc_id", "one.part").agg(F.collect_list(F.struct(
        "anchor", F.col("one.first").alias("first"), F.col("one.n").alias("n"), F.col("one.lead").alias("lead"),
        (F.col("c") > 1).alias("known"))).alias("runs"))

    def spell(batches):
        for b in slices(batches, "text"):
            data, off = utf8(b.column("text"))
            lists, each = b.column("runs"), b.column("runs").flatten()
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            first, n = (each.field(k).to_numpy() for k in (1, 2))
            step = max(1, OUTPUT // (2 * depth))
            for a in range(0, len(row), step):
                cut = slice(a, a + step)
                take = pa.array(row[cut], pa.int64())
                part = each.slice(a, step)
                yield pa.RecordBatch.from_arrays(
                    [part.field(0), b.column("doc_id").take(take), b.column("part").take(take), part.field(1), part.field(2), part.field(3),
                     part.field(4), gather(data, off[row[cut]] + first[cut], n[cut].astype(np.int64) - 1 + depth)],
                    names=["anchor", "doc_id", "part", "lo", "n", "lead", "known", "bytes"])

    return (_with_texts(rows, by_text, "inner").select("doc_id", "part", "text", "runs")
            .mapInArrow(spell, PIECES.format(id=id_type)))


def cutter(size: int, depth: int):
    """Cuts pieces into blocks of windows whose anchors lie ``size * place`` to
    ``size * place + size - 1`` bytes behind their start."""

    def cut(batches):
        for b in slices(batches, "bytes", PIECE // 2):
            data, off = utf8(b.column("bytes"))
            n, lead, lo = (b.column(k).to_numpy().astype(np.int64) for k in ("n", "lead", "lo"))
            low = (lead - n + 1) // size
            count = lead // size - low + 1
            row = np.repeat(np.arange(len(n)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
            near = np.maximum(place * size, lead[row] - n[row] + 1)               # of the block's windows: least and
            far = np.minimum(place * size + size - 1, lead[row])                  # greatest distance to the anchor
            c = prefix_hash(data)
            at = off[:-1][row] + lead[row]
            digit = window_hash(c, at - place * size, depth - size + 1)
            start, length = at - far, far - near + depth
            content = mix(window_hash(c, start, length) + far.astype(np.uint64) * _BYTE[0] + (far - near).astype(np.uint64) * _BYTE[1])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("anchor").take(take), pa.array(place.astype(np.int32)), pa.array(digit.view(np.int64)), pa.array(content.view(np.int64)),
                 b.column("doc_id").take(take), b.column("part").take(take), pa.array(lo[row] + lead[row] - far),
                 pa.array((far - near + 1).astype(np.int32)), pa.array(far.astype(np.int32)), b.column("known").take(take),
                 gather(data, start, length if size > 1 else 0 * length)],
                names=["anchor", "place", "digit", "content", "doc_id", "part", "lo", "n", "lead", "known", "bytes"])

    return cut


def tie(blocks: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """One digit pass: ranges of blocks found whole in several runs, and one block
    of each content of the groups that still differ."""
    keys = ["anchor", "place", "digit"]
    tied = staged(blocks.groupBy(*keys).agg(F.count("*").alias("c"), F.min("content").alias("least"), F.max("content").alias("most"),
                                               F.bool_and("known").alias("covered"))
                  .where("c > 1 and not covered").select(*keys, (F.col("least") == F.col("most")).alias("alike")), "tied")
    held = staged(blocks.join(tied, keys).where("not alike or not known"), "held", "zstd")
    kinds = staged(held.where("not alike").groupBy(*keys, "content").agg(
        F.count("*").alias("c"), F.min(F.struct("doc_id", "part", "lo", "known")).alias("one"), F.first("n").alias("n"),
        F.first("lead").alias("lead"), F.first("bytes").alias("bytes")), "kinds", "zstd")
    often = kinds.where("c > 1").select(*keys, "content")
    ranges = lambda df: df.where("not known").select(
        "doc_id", "part", "lo", (F.col("lo") + F.col("n") - 1 + depth).alias("hi"))
    done = ranges(held.where("alike")).unionByName(ranges(held.where("not alike").join(often, [*keys, "content"], "left_semi")))
    rest = kinds.select("anchor", "one.doc_id", "one.part", "one.lo", "n", "lead", (F.col("one.known") | (F.col("c") > 1)).alias("known"), "bytes")
    return done, rest


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                   gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, the maximal removed ``spans``
    (byte ranges lo, hi) and the ``kept`` bytes (binary: a cut may fall inside
    a character)."""
    if not 1 <= gram < depth <= 4096:
        raise ValueError("1 <= gram < depth <= 4096")
    ready(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    found = (repeated_spans(rows, depth, gram).groupBy("doc_id", "part")
             .agg(F.collect_list(F.struct("lo", "hi")).alias("found")))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])

    def cut(batches):
        for b in slices(batches, 1):
            data, off = utf8(b.column(1))
            spans, kept = [], []
            inner, at = b.column(2).flatten(), np.concatenate([[0], np.cumsum([0 if n is None else n for n in b.column(2).value_lengths().to_pylist()])])
            los, his = (inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                text = data[a:z]
                lo, hi = los[at[i]:at[i + 1]], his[at[i]:at[i + 1]]
                if not len(lo):
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                mark = np.zeros(len(text) + 1, np.int64)
                np.add.at(mark, lo, 1)
                np.add.at(mark, hi, -1)
                gone = np.cumsum(mark)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    return (_with_texts(rows, found, "left").select("doc_id", "text", "found")
            .mapInArrow(cut, f"doc_id {id_type}, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary"))
