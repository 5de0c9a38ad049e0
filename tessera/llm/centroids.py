"""Exact integer k-means by equal-average equal-variance search.

Components become integers ``floor(scale * x)``.  With sums S and deviations
V (V^2 is the sum of squared differences from the vector's own mean),

    |x - c|^2 >= (Sx - Sc)^2 / dims + (Vx - Vc)^2.

Centroids stand in the order of their means.  A vector's scan starts at its
own mean and goes outward on both sides; a side ends where the first term
alone is above the best distance found, a centroid whose two terms are above
it is passed over, and only the rest get their distance, in integers.  The
bounds are doubles with a margin above their rounding, and a centroid at
exactly the best distance is never passed over, so ties go to the smaller
number as in a full search.

A round is one pass over the staged points: tasks send one row for each
(cluster, component) that they have seen, sums are exact decimals, and the
driver holds clusters x components numbers, both of them parameters.

Vectors that are null, of another length, or hold null or non-finite
components are left out; an empty table gives no rows.  Rows count one by one,
so a repeated row weighs twice.  Rows with a null id are clustered, but start no
centroid (rows that share an id may start one each, in the order of their
components).  Fewer vectors than clusters give as many centroids as vectors.
Components of size ``sqrt(2**60 / dims) / scale`` or more, whose distances would not fit a
long, are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ready, staged
from .vectors import matrix, whole_vectors

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
CHUNK = 4096


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of every row, and how
    many distances were computed."""
    n, dims = x.shape
    k = len(centroids)

    def terms(a):
        s = a.sum(axis=1)
        spread = a - (s / dims)[:, None]
        return s, np.sqrt(np.einsum("ij,ij->i", spread, spread)), np.einsum("ij,ij->i", a, a).astype(float)

    order = np.argsort(centroids.sum(axis=1), kind="stable")
    cent = centroids[order]
    cs, cv, csq = terms(cent)
    xs, xv, xsq = terms(x)
    margin = 1e-10 * (xsq + csq.max()) + 1e-6
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    start = np.searchsorted(cs, xs)
    sides = [np.arange(n), np.arange(n)]
    computed = 0
    for step in range(k):
        for side in (0, 1):
            rows = sides[side]
            at = start[rows] + step if side == 0 else start[rows] - 1 - step
            inside = (at >= 0) & (at < k)
            rows, at = rows[inside], at[inside]
            gap = (xs[rows] - cs[at]).astype(float) ** 2 / dims - margin[rows]
            going = gap <= best[rows]
            rows, at, gap = rows[going], at[going], gap[going]
            sides[side] = rows
            close = gap + (xv[rows] - cv[at]) ** 2 <= best[rows]
            rows, at = rows[close], at[close]
            if not len(rows):
                continue
            apart = x[rows] - cent[at]
            dist, number = np.einsum("ij,ij->i", apart, apart), order[at]
            computed += len(rows)
            less = (dist < best[rows]) | ((dist == best[rows]) & (number < who[rows]))
            best[rows[less]], who[rows[less]] = dist[less], number[less]
        if not len(sides[0]) and not len(sides[1]):
            break
    return who, best, computed


def _points(batches, dims: int, limit: int):
    for b in batches:
        x = matrix(b.column("x"), dims)
        if len(x) and max(-int(x.min()), int(x.max())) >= limit:
            raise ValueError(f"a component of {limit} or more (scaled) has no exact distance in a long")
        for a in range(0, len(x), CHUNK):
            yield b.column("vec_id").slice(a, CHUNK), x[a:a + CHUNK]


def moved(points: DataFrame, centroids: np.ndarray, limit: int) -> np.ndarray:
    """Every non-empty centroid replaced by the floor of its vectors' mean."""
    k, dims = centroids.shape

    def sums(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _points(batches, dims, limit):
            who, _, _ = nearest(x, centroids)
            count += np.bincount(who, minlength=k)
            np.add.at(total, who, x)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(seen, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(seen))),
             pa.array(np.repeat(count[seen], dims)), pa.array(total[seen].ravel())], names=["cluster", "component", "n", "total"])

    out = centroids.copy()
    for r in (points.mapInArrow(sums, "cluster int, component int, n long, total long").groupBy("cluster", "component")
              .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()):
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS,
                    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The rows (vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256), one per kept vector, and the final centroids."""
    ready(vectors.sparkSession)
    limit = int((2**60 / dims) ** 0.5)
    kept = (whole_vectors(vectors, id_col, vec_col).where(F.size("x") == dims)
            .select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("x")))
    points = staged(kept, "points")
    first = (points.where("vec_id is not null")
             .select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"))
             .orderBy("h", "x").limit(clusters).collect())
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(points, centroids, limit)

    def assign(batches):
        for ids, x in _points(batches, dims, limit):
            who, dist, _ = nearest(x, centroids) if len(centroids) else ([None] * len(x), [None] * len(x), 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(dist, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    id_type = points.schema["vec_id"].dataType.simpleString()
    found = staged(points.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long"), "assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digest = vectors.sparkSession.createDataFrame(digests, "number int, centroid_sha256 string")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = found.groupBy("cluster").agg(exact.alias("part")).where("cluster is not null")
    whole = found.agg(exact.try_cast("long").alias("inertia"))
    by = (by.join(digest, F.col("cluster") == F.col("number")).crossJoin(whole)      # one row
          .select(F.col("cluster").alias("number"), F.col("part").try_cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256"))
    rows = (found.join(F.broadcast(by), F.col("cluster") == F.col("number"), "left")   # a row for each cluster
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
    return rows, centroids
