"""Vectorised byte and word kernels used inside Arrow tasks.

Every function works on a whole Arrow batch at a time, straight on the UTF-8
buffer of the column: no Python string is made per row or per word.  Long
buffers are worked through in pieces of about ``PIECE`` bytes, so temporary
memory does not follow the batch size.  Hashes are 64-bit and depend on the
bytes only, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser spreading every input bit over the 64 output bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9FB21C651E98DF25)
    x = x ^ (x >> _U(28))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants, the same everywhere for a seed."""
    return np.random.RandomState(seed).randint(1, 2**63 - 1, n, dtype=np.int64).astype(np.uint64) | _U(1)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (``base`` odd)."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_BASE = 0x9E3779B97F4A7C15
_POW, _IPOW = powers(PIECE + 1, _BASE)


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if n > len(_POW):
        _POW, _IPOW = powers(max(n, 2 * len(_POW)), _BASE)
    return _POW, _IPOW


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (or binary) column and its ``n + 1`` offsets; a null
    is as long as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:                       # bytes below a null slot do not count
        lens = np.where(np.asarray(col.is_valid()), np.diff(off), 0)
        if lens.sum() != off[-1] - off[0]:
            data = np.concatenate([data[a:a + k] for a, k in zip(off[:-1], lens)] or [data[:0]])
            off = np.concatenate([[0], np.cumsum(lens)])
    return data[off[0]:off[-1]], off - off[0]


def slices(batches, column: int | str, size: int = 4 << 20):
    """The batches in slices of at most ``size`` bytes of a text column (or one
    row), so that a task's arrays do not follow the rows of a batch."""
    for b in batches:
        col = b.column(column)
        _, off = utf8(col)
        a = 0
        while a < len(off) - 1:
            z = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
            yield b.slice(a, z - a)
            a = z


def word_table(separators: np.ndarray, seed: int = 7) -> np.ndarray:
    """Byte table: 0 for separators, one odd constant per (lower-cased) byte."""
    t = constants(256, seed)
    t[65:91] = t[97:123]
    t[separators] = 0
    return t


def _set(*spans) -> np.ndarray:
    return np.array([b for a, z in spans for b in range(a, z + 1)])


#: Words of ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
SPACED = word_table(_set((0x20, 0x20), (0x09, 0x0D)))
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = word_table(_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray, spans: bool = False):
    """Hash every word of every row.

    Returns the word hashes in order, the ``n + 1`` word offsets of the rows
    and, with ``spans``, start and end byte of each word in ``data``."""
    n, lo = len(data), 0
    hashes, starts, ends = [], [], []
    while lo < n:
        hi = lo + PIECE
        if hi >= n:
            hi = n
        else:
            row = int(off[np.searchsorted(off, hi, side="right") - 1])
            if row > lo:
                hi = row
            else:                            # one long row: cut at the next separator
                stop = int(off[np.searchsorted(off, lo, side="right")])
                while hi < stop:
                    gap = np.flatnonzero(table[data[hi:min(stop, hi + 4096)]] == 0)
                    if len(gap):
                        hi += int(gap[0])
                        break
                    hi = min(stop, hi + 4096)
        x = table[data[lo:hi]]
        word = x != 0
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        cuts = off[np.searchsorted(off, lo, side="right"):np.searchsorted(off, hi)] - lo
        if len(cuts):                        # rows touch: a word never crosses
            first[cuts] |= word[cuts]
            last[cuts - 1] |= word[cuts - 1]
        ws, we = np.flatnonzero(first), np.flatnonzero(last)
        if len(ws):
            pw, ipw = _pows(hi - lo + 1)
            c = np.cumsum(x * pw[:hi - lo], dtype=np.uint64)
            h = c[we]
            h[1:] -= c[ws[1:] - 1]
            if ws[0]:
                h[0] -= c[ws[0] - 1]
            hashes.append(mix(h * ipw[ws] + (we - ws).astype(np.uint64)))
            starts.append(ws + lo)
            ends.append(we + lo + 1)
        lo = hi
    z = np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else z
    word_off = np.searchsorted(s, off)
    word_off[-1] = len(s)
    return (h, word_off, s, np.concatenate(ends) if ends else z) if spans else (h, word_off)


def ngrams(h: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Order-sensitive hash of every run of ``n`` words (``len(h) - n + 1``)."""
    k = constants(n, seed)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * k[0]
    for i in range(1, n):
        out = mix(out) + h[i:m + i] * k[i]
    return mix(out)


def row_shingles(h: np.ndarray, off: np.ndarray, n: int):
    """Yield the sorted distinct shingle hashes of each row: runs of ``n``
    words, or the whole sequence of a shorter row; nothing without words."""
    grams = ngrams(h, n)
    short = {k: constants(k, 100 + k) for k in range(1, n)}
    for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
        k = z - a
        if k >= n:
            yield np.unique(grams[a:z - n + 1])
        elif k:
            out = np.array([k], np.uint64)
            for i in range(k):
                out = mix(out) + h[a + i:a + i + 1] * short[k][i]
            yield mix(out)
        else:
            yield h[:0]
