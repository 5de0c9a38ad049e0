"""Exact whitening of embeddings by bit-sliced scatter sums.

Entries become integers x = floor(scale * c) + offset.  A block of rows takes
each dimension's least value off, so that what is left is a few bits wide, and
packs every bit plane of every dimension across the rows into 64-bit words.
The sum over rows of y_i * y_j is then

    sum over planes p, q of 2**(p + q) * popcount(plane(i, p) & plane(j, q)),

a whole number without rounding, and the shifts are put back in whole
numbers.  Tasks send one row for each pair of dimensions; Spark adds them up as
decimals.  The driver holds dims x dims of these: it centres them as integers
(n * Q_ij - S_i * S_j), divides once, and takes the eigenvectors.  A second pass
projects the rows, a third measures the covariance of what came out.

Dropped: null vectors and those with a null or non-finite entry.  Vectors have one
length, that of most rows (the longer on a tie); rows of another length are
left out.  A component whose variance is below 1e-10 of the largest has no
direction that could be whitened and is left out (equal rows or one row: no
component, no result; neither has an empty table).  Rows count one by one; ids may be
null or repeated.  Entries of 2**35 and more in size, whose sums would not be exact, are an error.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ready, staged
from .vectors import matrix, whole_vectors

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = 1 << 42
BLOCK = 8192
FLAT = 1e-10


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Planes of non-negative integers (rows x dims) as (planes, dims, words):
    bit r of a row of words is the plane's bit of row r."""
    rows, dims = y.shape
    bits = int(y.max()).bit_length() if y.size else 0
    out = np.zeros((bits, dims, -(-rows // 64)), np.uint64)
    for p in range(bits):
        packed = np.packbits(((y >> p) & 1).astype(np.uint8), axis=0)
        padded = np.zeros((out.shape[2] * 8, dims), np.uint8)
        padded[:len(packed)] = packed
        out[p] = np.ascontiguousarray(padded.T).view(np.uint64)
    return out


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (Python integers) of rows of integers."""
    rows, dims = x.shape
    low = x.min(axis=0)
    planes = bit_planes(x - low)
    shifted, total = np.zeros((dims, dims), object), np.zeros(dims, object)
    for p in range(len(planes)):
        total = total + (np.bitwise_count(planes[p]).sum(axis=1, dtype=np.int64).astype(object) << p)
        for q in range(p, len(planes)):
            both = np.stack([np.bitwise_count(planes[q] & row).sum(axis=1, dtype=np.int64) for row in planes[p]])
            shifted = shifted + ((both if p == q else both + both.T).astype(object) << (p + q))
    low = low.astype(object)
    cross = shifted + np.outer(low, total) + np.outer(total, low) + rows * np.outer(low, low)
    return total + rows * low, cross


def _blocks(batches, dims: int):
    for b in batches:
        x = matrix(b.column("x"), dims)
        for a in range(0, len(x), BLOCK):
            yield b.column("vec_id").slice(a, BLOCK), x[a:a + BLOCK]


def exact_sums(points: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, Q): rows, sums and cross-products, as Python integers."""
    schema = "i int, j int, total decimal(38,0)"

    def add(batches):
        n, s, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for _, x in _blocks(batches, dims):
            if max(-int(x.min()), int(x.max())) >= LARGEST:
                raise ValueError("an entry is too large for exact sums")
            some, products = scatter(x)
            n, s, cross = n + len(x), s + some, cross + products
        if not n:
            return
        i, j = np.triu_indices(dims)
        rows = [*zip(i.tolist(), j.tolist(), cross[i, j]), *((k, dims, s[k]) for k in range(dims)), (dims, dims, n)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([Decimal(int(r[2])) for r in rows], pa.decimal128(38, 0))], names=["i", "j", "total"])

    sums = {(r.i, r.j): int(r.total) for r in points.mapInArrow(add, schema).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    n = sums.get((dims, dims), 0)
    return (n, [sums.get((k, dims), 0) for k in range(dims)],
            [[sums.get((min(i, j), max(i, j)), 0) for j in range(dims)] for i in range(dims)])


def components_of(n: int, s: list[int], q: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, shares of the variance) of the
    covariance, by falling eigenvalue; the entry of largest size is positive."""
    dims = len(s)
    cov = np.array([[(n * q[i][j] - s[i] * s[j]) / (n * n) for j in range(dims)] for i in range(dims)], float).reshape(dims, dims)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    take = np.flatnonzero(values > FLAT * max(values.max(initial=0.0), 0.0))[:most]
    values, vectors = values[take], vectors[:, take]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(take))]) if len(take) else 1.0
    return values, vectors * sign, values / np.trace(cov) if len(take) else values


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, n, deviation decimal(38,0), whitened array<double>, explained
    array<double>, identity_error), one row per remaining vector."""
    spark = vectors.sparkSession
    ready(spark)
    whole = whole_vectors(vectors, id_col, vec_col)
    length = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = length.d if length else 0
    points = staged(whole.where(F.size("x") == dims)
                    .select("vec_id", F.transform("x", lambda v: F.floor(v * scale) + offset).alias("x")), "points")
    n, s, q = exact_sums(points, dims) if dims else (0, [], [])
    id_type = points.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, deviation string, whitened array<double>"
    shape = f"vec_id {id_type}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    values, axes, shares = components_of(n, s, q, components) if n else (np.zeros(0), None, None)
    if not len(values):
        return spark.createDataFrame([], shape)
    turn = axes / np.sqrt(values)
    small = n * LARGEST < 2**61
    sums = np.array(s, np.int64 if small else object)

    def centred(x):
        """n * x - S in whole numbers, and the whitened rows."""
        y = (x if small else x.astype(object)) * n - sums
        return y, (y / n).astype(float) @ turn

    def project(batches):
        for ids, x in _blocks(batches, dims):
            y, white = centred(x)
            if int(np.abs(y).max(initial=0)) ** 2 * dims >= 2**62:
                y = y.astype(object)
            deviation = pa.array([str(v) for v in (y * y).sum(axis=1).tolist()], pa.string())
            ends = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([ids, deviation, pa.ListArray.from_arrays(ends, white.ravel())],
                                             names=["vec_id", "deviation", "whitened"])

    def moments(batches):
        k = turn.shape[1]
        out = np.zeros((k + 1, k))
        for _, x in _blocks(batches, dims):
            _, white = centred(x)
            out[:k] += white.T @ white
            out[k] += white.sum(axis=0)
        i, j = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
                                          pa.array(out.ravel())], names=["i", "j", "total"])

    got = np.zeros((len(values) + 1, len(values)))
    for r in points.mapInArrow(moments, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("t")).collect():
        got[r.i, r.j] = r.t / n
    error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(len(values))).max())
    return (points.mapInArrow(project, schema)
            .select("vec_id", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
                    F.lit([float(v) for v in shares]).alias("explained"), F.lit(error).alias("identity_error")))
