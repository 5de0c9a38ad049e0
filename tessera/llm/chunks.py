"""Substring deduplication with content-defined chunks.

A gear hash rolls over the bytes of a text: h(i) = sum of G[byte(i - j)] << j
over the last 16 bytes, modulo 2**16.  A place whose ``bits`` top bits are 0 is
a candidate cut; it is taken when the last cut (or the start of the text) lies
at least ``least`` bytes before it, and a piece longer than ``most`` is cut
evenly from its start.  A candidate with no other one in the ``least`` bytes
before it is always taken, so cuts fall into step again soon after an
insertion and the chunks behind it do not change.

Chunks are compared by digest (96 bits) over the whole corpus with partial
aggregation; a chunk held by very many documents is met by a join that
adaptive execution splits.  A run of neighbouring repeated chunks counts as a
repeated passage when it has ``passage`` bytes or is the whole text (single
short chunks, a few common words, repeat by chance).  In a repeated passage
each chunk stays only where it comes first: in the smallest id that holds it,
and there at its first place.

Null texts count as empty; rows that share the smallest id all keep their
first place; a null id is smaller than none: it keeps a chunk only when no
other id holds it; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import PIECE, constants, slices, utf8
from .repeats import prefix_hash, window_hash
from .tables import ready, staged

BITS, LEAST, MOST, PASSAGE = 5, 16, 256, 96
WINDOW = 16
_GEAR = (constants(256, 53) >> np.uint64(17)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling 16-byte gear hash at every byte."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8):
        h[s:] = h[s:] + (h[:-s] << np.uint16(s))
    return h


def cuts(data: np.ndarray, off: np.ndarray, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of all chunks (rows one after another) and chunk offsets of
    the rows; a chunk ends where the next one starts."""
    found = []
    for lo in range(0, len(data), PIECE):
        back = min(lo, WINDOW)
        h = gear(data[lo - back:lo + PIECE])[back:]
        found.append(np.flatnonzero(h >> np.uint16(16 - bits) == 0) + lo + 1)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    begins = off[:-1][np.diff(off) > 0]
    row_begin = off[np.searchsorted(off, places - 1, side="right") - 1] if len(places) else places
    places = places[places - row_begin >= WINDOW]          # the hash looks back that far
    every = np.union1d(places, begins)
    taken = np.isin(every, begins, assume_unique=True)
    taken |= np.diff(every, prepend=-least) >= least
    begin_of = np.append(begins, len(data))[np.searchsorted(begins, every, side="right")] if len(every) else every
    step = np.searchsorted(every, np.minimum(every + least, begin_of))     # the next one far enough
    reach = np.flatnonzero(taken)
    while len(reach):
        reach = step[reach]
        reach = np.unique(reach[reach < len(every)])
        reach = reach[~taken[reach]]
        taken[reach] = True
    starts = every[taken]
    starts = starts[starts < len(data)]
    length = np.diff(np.append(starts, len(data)))
    extra = np.maximum(length - 1, 0) // most
    starts = np.repeat(starts, extra + 1) + most * (np.arange((extra + 1).sum())
                                                    - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))
    return starts, np.searchsorted(starts, off)


def digests(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 further bits for each chunk."""
    ends = np.append(starts[1:], len(data))
    one, two, k = [], [], 0
    while k < len(starts):
        z = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, side="right")))
        lo = starts[k]
        part = data[lo:ends[z - 1]]
        s, n = starts[k:z] - lo, ends[k:z] - starts[k:z]
        one.append(window_hash(prefix_hash(part), s, n) + n.astype(np.uint64))
        two.append(window_hash(prefix_hash(part ^ np.uint8(0x5B)), s, n) >> np.uint64(32))
        k = z
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(one).view(np.int64), np.concatenate(two).astype(np.uint32).view(np.int32)


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
                         least: int = LEAST, most: int = MOST, passage: int = PASSAGE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_chunks, n_repeated (bytes in
    repeated passages), the removed ``spans`` and the ``kept`` bytes (binary)."""
    if least < WINDOW or most < least or not 1 <= bits <= 12:
        raise ValueError(f"{WINDOW} <= least <= most and 1 <= bits <= 12")
    ready(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce(F.hash("text"), F.lit(0)).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def chunk(batches):
        for b in slices(batches, 2):
            data, off = utf8(b.column(2))
            starts, at = cuts(data, off, bits, least, most)
            d1, d2 = digests(data, starts)
            take = pa.array(np.repeat(np.arange(len(off) - 1), np.diff(at)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(d1, pa.int64()), pa.array(d2, pa.int32())],
                names=["doc_id", "part", "d1", "d2"])

    every = rows.mapInArrow(chunk, f"doc_id {id_type}, part int, d1 long, d2 int")
    twice = (every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("holder"))
             .where("n > 1").select("d1", "d2", "holder"))
    twice = staged(twice, "twice")           # a table of its own: the join with it can be split at hot keys
    found = (every.join(twice, ["d1", "d2"])
             .select("doc_id", "part", "d1", "d2", F.col("doc_id").eqNullSafe(F.col("holder")).alias("mine"))
             .groupBy("doc_id", "part").agg(F.collect_set(F.struct("d1", "d2", "mine")).alias("found"))
             .withColumnsRenamed({"doc_id": "__id", "part": "__part"}))
    span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])

    def cut(batches):
        for b in slices(batches, 1):
            data, off = utf8(b.column(1))
            starts, at = cuts(data, off, bits, least, most)
            d1, d2 = digests(data, starts)
            ends = np.append(starts[1:], len(data))
            sizes = np.array([0 if n is None else n for n in b.column(2).value_lengths().to_pylist()], np.int64)
            inner, edge = b.column(2).flatten(), np.concatenate([[0], np.cumsum(sizes)])
            f1, f2, mine = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            n_chunks, n_rep, spans, kept = np.diff(at), [], [], []
            for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                known = {(x, y): m for x, y, m in zip(f1[edge[i]:edge[i + 1]].tolist(), f2[edge[i]:edge[i + 1]].tolist(),
                                                     mine[edge[i]:edge[i + 1]].tolist())}
                gone, repeated = [], 0
                if known:
                    own = list(zip(d1[at[i]:at[i + 1]].tolist(), d2[at[i]:at[i + 1]].tolist()))
                    s, e = starts[at[i]:at[i + 1]].tolist(), ends[at[i]:at[i + 1]].tolist()
                    run, seen = 0, set()
                    for k in range(len(own) + 1):
                        if k < len(own) and own[k] in known:
                            continue
                        if k > run and (e[k - 1] - s[run] >= passage or (run == 0 and k == len(own))):
                            repeated += e[k - 1] - s[run]
                            for j in range(run, k):
                                if known[own[j]] and own[j] not in seen:
                                    seen.add(own[j])
                                elif gone and gone[-1][1] == s[j] - a:
                                    gone[-1][1] = e[j] - a
                                else:
                                    gone.append([s[j] - a, e[j] - a])
                        run = k + 1
                n_rep.append(repeated)
                spans.append([{"lo": x, "hi": y} for x, y in gone])
                text_, last, keep = data[a:z].tobytes(), 0, []
                for x, y in gone:
                    keep.append(text_[last:x])
                    last = y
                kept.append(b"".join([*keep, text_[last:]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(n_chunks, pa.int64()), pa.array(n_rep, pa.int64()),
                 pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_chunks", "n_repeated", "spans", "kept"])

    return (rows.join(found, rows["doc_id"].eqNullSafe(found["__id"]) & (rows["part"] == found["__part"]), "left")
            .select("doc_id", "text", "found")
            .mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_chunks long, n_repeated long, "
                             "spans array<struct<lo: long, hi: long>>, kept binary"))
