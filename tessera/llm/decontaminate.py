"""Benchmark decontamination with suffix arrays over shards of the corpus.

A shard is a run of whole documents of one Arrow batch, about ``SHARD_WORDS``
words.  Its suffix array holds the word positions at which a test window could
start (their leading words occur in the benchmark at all), sorted by the words
that follow to the depth of a window.  Every test suffix is then looked up by
binary search, all of them at once; the equal range gives every location in
the shard.  Matches at consecutive positions along one item join to the
longest verbatim match.  Nothing is shuffled: documents stay in their scan
partition, so a benchmark passage in a third of all rows is no hot key.

The benchmark is the stated query set, of any size.  It is read in blocks, each
broadcast, and up to ``pass_bytes`` of it meet the documents in one pass.  A
larger one takes several passes: what a pass found (runs of hit words, items,
the longest match) is written with the texts and carried into the next, where
runs that overlap are united, so that words and items count once.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, held as
64-bit hashes.  A window is ``window`` consecutive item words; an item with
fewer (but some) words is one window.  Null or empty texts have no words and
match nothing; equal items all count; items with a null id are left out;
rows are treated one by one, so repeated rows and repeated ids each keep a
result; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, slices, utf8, words
from .tables import ready, staged

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16 << 20
#: Bytes of the benchmark in a pass; a Python worker holds about nine times as many.
PASS_BYTES = 32 << 20

SCHEMA = ("doc_id {id}, n_words long, n_hit long, items array<string>, longest_match long, "
          "longest_at long, longest_item string")
#: What a pass hands on beside id and text: hit words as runs (first, behind the last), one after another.
CARRIED = "items array<string>, longest_match long, longest_at long, longest_item string, runs array<long>"


class TestSuffixes:
    """Windows of a block of benchmark items, ready to be searched."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, off = utf8(pa.array([t for _, t in items], pa.string()))
        h, woff = words(data, off, ALNUM)
        self.window = window
        self.vocab = np.unique(h)
        ids = (np.searchsorted(self.vocab, h) + 1).astype(np.int64)
        self.bits = max(1, int(len(self.vocab) + 1).bit_length())
        self.per_key = max(1, min(window, 63 // self.bits))
        self.n_keys = -(-window // self.per_key)
        texts: dict[bytes, int] = {}             # equal word sequences are one text
        self.names: list[list[str]] = []
        rows, spots = [], []
        for (name, _), a, z in zip(items, woff[:-1].tolist(), woff[1:].tolist()):
            if a == z:
                continue
            seq = ids[a:z].tobytes()
            if seq in texts:
                self.names[texts[seq]].append(name)
                continue
            texts[seq] = k = len(self.names)
            self.names.append([name])
            if z - a < window:
                rows.append(np.concatenate([ids[a:z], np.zeros(window - (z - a), np.int64)])[None, :])
                spots.append(np.array([[k, 0]]))
            else:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids[a:z], window))
                m = z - a - window + 1
                spots.append(np.stack([np.full(m, k), np.arange(m)], axis=1))
        self.n = 0
        if not rows:
            return
        every, at = np.concatenate(rows), np.concatenate(spots)
        windows, which = np.unique(every, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        self.n = len(windows)
        self.spots = at[order].astype(np.int32)  # (text, place) of each window
        self.spot_off = np.searchsorted(which.ravel()[order], np.arange(self.n + 1))
        self.length = (windows > 0).sum(axis=1)
        self.lead = int(min(self.length.min(), 3))
        self.low = self._keys(windows)
        self.short = np.flatnonzero(self.length < window)     # what follows a short item may be any word
        brief = windows[self.short]
        self.high = self._keys(np.where(brief == 0, (1 << self.bits) - 1, brief))

    def _keys(self, rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(self.n_keys):
            key = np.zeros(len(rows), np.int64)
            for i in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << self.bits) | (rows[:, i] if i < rows.shape[1] else 0)
            out.append(key)
        return out

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions in order of the ``window`` words that follow; ``ids`` ends
        each document with a 0."""
        start = ids != 0
        for i in range(1, self.lead):
            start[:-i] &= ids[i:] != 0
            start[len(ids) - i:] = False
        pos = np.flatnonzero(start)
        tail = np.concatenate([ids, np.zeros(self.window, np.int64)])
        keys, over = [], np.zeros(len(pos), bool)  # past a document's end (or a foreign word) all is 0
        for k in range(self.n_keys):
            key = np.zeros(len(pos), np.int64)
            for i in range(k * self.per_key, (k + 1) * self.per_key):
                w = tail[pos + i] if i < self.window else 0
                over |= w == 0
                key = (key << self.bits) | np.where(over, 0, w)
            keys.append(key)
        order = np.lexsort(keys[::-1]) if len(pos) else pos
        return pos[order], [k[order] for k in keys]

    @staticmethod
    def search(keys: list[np.ndarray], probe: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of every probe at once: first place not below it, or
        with ``after`` the first place above it."""
        n, q = len(keys[0]), len(probe[0])
        lo, hi = np.zeros(q, np.int64), np.full(q, n, np.int64)
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi) // 2, 0)
            below, same = np.zeros(q, bool), np.ones(q, bool)
            for k, p in zip(keys, probe):
                at = k[mid]
                below |= same & (at < p)
                same &= at == p
            go = open_ & (below | same if after else below)
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    def match(self, h: np.ndarray, off: np.ndarray):
        """For the documents of a shard: which of their words are hit, the texts
        that occur and the longest match as (words, position, text)."""
        docs = len(off) - 1
        hit, found, longest = np.zeros(len(h), bool), [set() for _ in range(docs)], {}
        if not self.n or not len(h):
            return hit, found, longest
        place = np.searchsorted(self.vocab, h)
        place[place == len(self.vocab)] = 0
        known = np.where(self.vocab[place] == h, place + 1, 0).astype(np.int64)
        doc_of = np.repeat(np.arange(docs), np.diff(off))
        ids = np.zeros(len(h) + docs, np.int64)
        at = np.arange(len(h)) + doc_of
        ids[at] = known
        sa, keys = self.suffix_array(ids)
        if not len(sa):
            return hit, found, longest
        lo, hi = self.search(keys, self.low, False), self.search(keys, self.low, True)
        if len(self.short):
            hi[self.short] = self.search(keys, self.high, True)
        hits = np.flatnonzero(hi > lo)
        if not len(hits):
            return hit, found, longest
        count = (hi - lo)[hits]
        window = np.repeat(hits, count)
        pos = sa[np.repeat(lo[hits] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + self.length[window], -1)
        doc_at = np.zeros(len(ids), np.int64)
        doc_at[at] = doc_of
        hit = (np.cumsum(cover)[:-1] > 0)[at]
        many = np.diff(self.spot_off)[window]
        text = self.spots[np.repeat(self.spot_off[window] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                          + np.arange(many.sum())]
        pos, length = np.repeat(pos, many), np.repeat(self.length[window], many)
        doc = doc_at[pos]
        for d, t in np.unique(np.stack([doc, text[:, 0]], axis=1), axis=0).tolist():
            found[d].add(t)
        order = np.lexsort((pos, pos - text[:, 1], text[:, 0]))
        p, t, g, ln = pos[order], text[order, 0], (pos - text[:, 1])[order], length[order]
        head = np.ones(len(p), bool)
        head[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(head)
        run = np.diff(np.append(first, len(p))) - 1 + ln[first]
        for d, k, a, x in zip(doc_at[p[first]].tolist(), run.tolist(), p[first].tolist(), t[first].tolist()):
            if (best := longest.get(d)) is None or (-k, a, x) < best:
                longest[d] = (-k, a, x)
        begin = off[:-1] + np.arange(docs)
        return hit, found, {d: (-k, a - int(begin[d]), x) for d, (k, a, x) in longest.items()}


def test_passes(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int,
                pass_bytes: int) -> Iterator[list]:
    """The benchmark's test suffixes, broadcast in blocks of about ``block_bytes``;
    one list of blocks, of about ``pass_bytes`` together, for each pass."""
    spark = benchmark.sparkSession
    items = (benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
             .where("item is not null and text is not null"))
    blocks, block, used, held = [], [], 0, 0
    for r in items.toLocalIterator():
        block.append((r["item"], r["text"]))
        used += len(r["text"].encode()) + len(r["item"].encode())
        if used >= min(block_bytes, pass_bytes):
            blocks.append(spark.sparkContext.broadcast(TestSuffixes(block, window)))
            block, used, held = [], 0, held + used
            if held >= pass_bytes:
                yield blocks
                blocks, held = [], 0
    if block:
        blocks.append(spark.sparkContext.broadcast(TestSuffixes(block, window)))
    if blocks:
        yield blocks


test_passes.__test__ = False


def _scan(col, blocks) -> list[tuple]:
    """One result per row of the column, shard by shard: (words, items, longest
    match, its place, its item, runs of hit words)."""
    data, off = utf8(col)
    h, woff = words(data, off, ALNUM)
    out, a = [], 0
    while a < len(off) - 1:
        z = max(a + 1, int(np.searchsorted(woff, woff[a] + SHARD_WORDS, side="right")) - 1)
        part = woff[a:z + 1]
        hw, po = h[part[0]:part[-1]], part - part[0]
        hit, names, best = np.zeros(len(hw), bool), [set() for _ in range(z - a)], {}
        for b in blocks:
            own, found, longest = b.value.match(hw, po)
            hit |= own
            for x, f in zip(names, found):
                x.update(n for t in f for n in b.value.names[t])
            for d, (k, p, t) in longest.items():
                best[d] = better(best.get(d), (k, p, min(b.value.names[t])))
        for d in range(z - a):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[po[d]:po[d + 1]], [False]])))
            out.append((int(po[d + 1] - po[d]), names[d], best.get(d), edge.tolist()))
        a = z
    return out


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The longer of two matches (words, place, item); ties: first place, smaller item."""
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda m: (-m[0], m[1], m[2]))


def united(a: list[int], b: list[int]) -> list[int]:
    """Two lists of runs as one: runs that overlap or touch become one run."""
    if not a or not b:
        return a or b
    out: list[int] = []
    for first, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: words, words inside a test window, the items that
    occur, and the longest verbatim match with its word position and item."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(blocks, carried: bool, last: bool):
        def run(batches):
            for b in slices(batches, 1):
                rows = _scan(b.column(1), blocks)
                if carried:
                    old = b.select(["items", "longest_match", "longest_at", "longest_item", "runs"]).to_pylist()
                    rows = [(n, x | set(o["items"]),
                             better((o["longest_match"], o["longest_at"], o["longest_item"]) if o["longest_match"] else None, m),
                             united(o["runs"], r)) for (n, x, m, r), o in zip(rows, old)]
                shared = {"items": pa.array([sorted(x) for _, x, _, _ in rows], pa.list_(pa.string())),
                          "longest_match": pa.array([m[0] if m else 0 for _, _, m, _ in rows], pa.int64()),
                          "longest_at": pa.array([m[1] if m else None for _, _, m, _ in rows], pa.int64()),
                          "longest_item": pa.array([m[2] if m else None for _, _, m, _ in rows], pa.string())}
                if last:
                    counts = {"n_words": pa.array([n for n, _, _, _ in rows], pa.int64()),
                              "n_hit": pa.array([sum(r[1::2]) - sum(r[::2]) for _, _, _, r in rows], pa.int64())}
                    yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), **counts, **shared})
                else:
                    yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": b.column(1), **shared,
                                                      "runs": pa.array([r for _, _, _, r in rows], pa.list_(pa.int64()))})
        return run

    carried, waiting = False, []
    for blocks in test_passes(benchmark, item_col, item_text, window, block_bytes, pass_bytes):
        if waiting:                              # another pass follows
            rows = staged(rows.mapInArrow(scan(waiting, carried, False), f"doc_id {id_type}, text string, {CARRIED}"), "matches")
            carried = True
            release(waiting)
        waiting = blocks
    return rows.mapInArrow(scan(waiting, carried, True), SCHEMA.format(id=id_type))


def release(blocks: list) -> None:
    """Free the copies of a pass whose result is written."""
    for b in blocks:
        b.destroy()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
                  pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents, all columns as they were, without those that hold a word
    inside an occurrence of a test window.  A pass works on what the one before
    it left."""
    ready(docs.sparkSession)
    place, schema = docs.columns.index(text_col), docs.schema

    def clean(blocks):
        def run(batches):
            for b in slices(batches, place):
                yield b.filter(pa.array([not r[3] for r in _scan(b.column(place).cast(pa.string()), blocks)], pa.bool_()))
        return run

    waiting: list = []
    for blocks in test_passes(benchmark, item_col, item_text, window, block_bytes, pass_bytes):
        if waiting:
            docs = staged(docs.mapInArrow(clean(waiting), schema), "clean")
            release(waiting)
        waiting = blocks
    return docs.mapInArrow(clean(waiting), schema)
