"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are one node with a weight.
2. Cores.  Groups of very many near copies would link every member with every
   other.  From ``SAMPLE`` nodes (in hash order) at most ``CORES`` pivots are
   fitted, each the mean direction of at least ``CORE_MIN`` of them.  All nodes
   within ``RHO`` of their nearest pivot are its core: 2 * RHO is less than the
   linking angle, so they all link, and they are counted, not compared.  Every
   other node sees every pivot: with (angle + RHO) within the linking angle
   it links with the whole core, with (angle - RHO) beyond it with none of it,
   and in between it is compared with the core's members in blocks.  This part
   is exact.
3. The other nodes are dealt to overlapping cluster shards: a shard of more
   than ``LIMIT`` nodes is split by centroids fitted on a bounded sample of it,
   each node goes to its ``overlap`` nearest (two at deeper levels), until none
   is larger.
4. Each shard builds its robust-pruned graph (``flatgraph``).  A node's lists from
   all its shards are united, and within each shard every member is searched
   for from the shard's medoid, expanding all that it meets in range.  Pairs found
   are verified in double precision.  A pair counts in the first shard
   that both share, so only counts and spanning links leave a task.
5. ``AUDIT`` nodes (in hash order) are compared with all nodes.  Where less than
   ``RECALL`` of their links was found, step 3 is repeated with twice the
   overlap, up to ``ATTEMPTS`` times; the last share is the column
   ``audited_recall``.

Links: cosine >= ``threshold`` of vectors with as many components, the row's own
vector left out, copies counted one by one.  Vectors that are null, zero, empty or
hold null or non-finite components link with nothing.  Rows with a null id are
compared like others, but no id of theirs can be smallest: a component without any id
has a null component_id, and its rows are kept.  Rows that share an id are
compared one by one; a kept id keeps all its rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flatgraph
from .components import connected_components
from .tables import ready, staged
from .vectors import whole_vectors

THRESHOLD, RHO = 0.9, 0.978                  # cosines
SAMPLE, CORES, CORE_MIN = 4096, 256, 16
LIMIT, FAN, OVERLAP, PER_SEED = 4096, 1024, 3, 16
AUDIT, RECALL, ATTEMPTS = 1000, 0.98, 3
BLOCK, ROWS = 4096, 1024
SLACK = 1e-9                                 # of an angle
PLACED = "key string, dims int, weight long, vec binary, core int, near array<int>, maybe array<int>"
MEMBER = "shard long, key string, h long, weight long, vec binary"


def unit_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, key, dims, vec): digest and unit vector (doubles) of each row that
    can link; a null key for the others."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x"))
    whole = whole_vectors(rows, "vec_id", "x").where(F.exists("x", lambda v: v != 0))

    def units(batches):
        for b in batches:
            col = b.column("x")
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *col.value_lengths().to_pylist()])
            keys, vecs = [], []
            for a, z in zip(ends[:-1], ends[1:]):
                x = flat[a:z] + 0.0                       # one zero
                keys.append(hashlib.md5(x.tobytes()).hexdigest())
                x = x / np.abs(x).max()
                vecs.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.string()), pa.array(np.diff(ends).astype(np.int32)),
                                              pa.array(vecs, pa.binary())], names=["vec_id", "key", "dims", "vec"])

    other = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")))
    inf = F.lit(float("inf"))
    linkable = (F.col("x").isNotNull() & F.forall("x", lambda v: F.coalesce((v < inf) & (v > -inf), F.lit(False)))
                & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False)))
    none = other.where(~F.coalesce(linkable, F.lit(False))).select(
        "vec_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("dims"), F.lit(None).cast("binary").alias("vec"))
    return whole.mapInArrow(units, "vec_id long, key string, dims int, vec binary").unionByName(none)


def _stack(col, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dims)


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def fit_pivots(sample: np.ndarray, rho: float, least: int, most: int) -> np.ndarray:
    """Mean directions of the densest groups of the sample, one after the other."""
    out, left = [], np.arange(len(sample))
    cos = sample @ sample.T
    while len(out) < most and len(left) >= least:
        around = cos[np.ix_(left, left)] >= 2 * rho**2 - 1         # two in one core
        who = int(around.sum(axis=1).argmax())
        mean = sample[left[around[who]]].mean(axis=0)
        mean /= np.linalg.norm(mean) or 1.0
        inside = sample[left] @ mean >= rho
        if inside.sum() < least:
            break
        out.append(mean)
        inside[who] = True
        left = left[~inside]
    return np.array(out).reshape(-1, sample.shape[1])


def place(nodes: DataFrame, pivots: dict[int, tuple[int, np.ndarray]], link: float, rho: float) -> DataFrame:
    """Core of each node (null: none), the cores it links with whole (``near``)
    and those it must be compared with (``maybe``).  Of two cores the members of the
    first are compared with the second."""

    def deal(batches):
        for b in batches:
            dims = np.asarray(b.column("dims"))
            core, near, maybe = [None] * len(dims), [[]] * len(dims), [[]] * len(dims)
            for d in np.unique(dims).tolist():
                base, p = pivots.get(d, (0, ()))
                if not len(p):
                    continue
                at = np.flatnonzero(dims == d)
                angle = _angle(_stack(b.column("vec").take(pa.array(at, pa.int64())), d) @ p.T)
                mine = np.where(angle.min(axis=1) <= rho, angle.argmin(axis=1), -1)
                after = np.arange(len(p)) > mine[:, None]
                whole = after & (angle + rho <= link - SLACK)
                some = after & ~whole & (angle - rho <= link + SLACK)
                for r in np.flatnonzero((mine >= 0) | whole.any(axis=1) | some.any(axis=1)).tolist():
                    core[at[r]] = base + int(mine[r]) if mine[r] >= 0 else None
                    near[at[r]] = (base + np.flatnonzero(whole[r])).tolist()
                    maybe[at[r]] = (base + np.flatnonzero(some[r])).tolist()
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("dims"), b.column("weight"), b.column("vec"), pa.array(core, pa.int32()), pa.array(near, ints),
                 pa.array(maybe, ints)], names=["key", "dims", "weight", "vec", "core", "near", "maybe"])

    return nodes.select("key", "dims", "weight", "vec").mapInArrow(deal, PLACED)


def core_name(core):
    return F.concat(F.lit("core"), core.cast("string"))


def against_cores(placed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, found) weights of links that concern cores and (a, b) links of names
    (a node's key or its core's name)."""
    name = F.coalesce(core_name(F.col("core")), F.col("key")).alias("a")
    size = placed.where("core is not null").groupBy("core").agg(F.sum("weight").alias("size"), F.count("*").alias("members"))
    size = staged(size, "cores")                                    # at most CORES rows
    near = placed.select("key", "core", "weight", name, F.explode("near").alias("c"))
    sizes = F.broadcast(size.select(F.col("core").alias("c"), "size", "members"))
    found = near.join(sizes, "c").groupBy("key").agg(F.sum("size").alias("found"))
    gain = near.groupBy("c").agg(F.sum("weight").alias("gain"))
    inside = (placed.where("core is not null")
              .join(F.broadcast(size.select("core", "size")), "core").join(F.broadcast(gain.withColumnRenamed("c", "core")), "core", "left")
              .select("key", (F.col("size") - F.col("weight") + F.coalesce("gain", F.lit(0))).alias("found")))
    links = near.select("a", core_name(F.col("c")).alias("b")).distinct()
    asks = (placed.select("key", "dims", "weight", "vec", name, F.explode("maybe").alias("c"))
            .join(F.broadcast(size.select(F.col("core").alias("c"), "members")), "c")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.floor(F.col("members") / BLOCK).cast("int")))))
    asked = F.broadcast(asks.select("c").distinct())                # at most CORES rows
    members = (placed.where("core is not null").withColumn("c", F.col("core")).join(sizes.select("c", "members"), "c").join(asked, "c")
               .withColumn("block", F.pmod(F.xxhash64("key"), F.floor(F.col("members") / BLOCK) + 1).cast("int")))
    cols = ["c", "block", "role", "key", "dims", "weight", "vec", "a"]
    rows = (members.withColumns({"role": F.lit(0), "a": F.lit("")}).select(cols)
            .unionByName(asks.withColumn("role", F.lit(1)).select(cols))
            .repartition("c", "block").sortWithinPartitions("c", "block", "role"))

    def compare(batches):
        run, keys, held, weights, got = None, [], None, None, None
        empty = lambda: pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int32())],
                                                   names=["key", "found", "a", "c"])

        def flush():
            if run is None or got is None or not len(got):
                return empty()
            at = np.flatnonzero(got)
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at.tolist()], pa.string()), pa.array(got[at]),
                                               pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int32())], names=["key", "found", "a", "c"])

        for b in batches:
            heads = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            cuts = [0, *[i for i in range(1, len(heads)) if heads[i] != heads[i - 1]], len(heads)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                c, block, role = heads[a]
                part = b.slice(a, z - a)
                if (c, block) != run:
                    yield flush()
                    run, keys, held, weights, got = (c, block), [], None, None, None
                dims = part.column("dims")[0].as_py()
                x, w = _stack(part.column("vec"), dims), part.column("weight").to_numpy()
                if role == 0:
                    keys.extend(part.column("key").to_pylist())
                    held = x if held is None else np.vstack([held, x])
                    weights = w if weights is None else np.append(weights, w)
                    got = np.zeros(len(weights), np.int64)
                elif held is not None:
                    linked = x @ held.T >= threshold
                    got += w @ linked
                    n = linked @ weights
                    at = np.flatnonzero(n)
                    take = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("key").take(take), pa.array(n[at], pa.int64()), part.column("a").take(take),
                                                      part.column("c").take(take)], names=["key", "found", "a", "c"])
        yield flush()

    checked = staged(rows.mapInArrow(compare, "key string, found long, a string, c int"), "compared")
    found = found.unionByName(inside).unionByName(checked.select("key", "found"))
    links = links.unionByName(checked.where("a is not null").select("a", core_name(F.col("c")).alias("b")))
    return found, links


def cluster_shards(nodes: DataFrame, limit: int, fan: int, overlap: int, max_levels: int = 12) -> DataFrame:
    """(shard, key, h, weight, vec): each node in its nearest clusters, no shard
    above ``limit``."""
    members = nodes.select(F.xxhash64("dims").alias("shard"), "key", F.xxhash64("key").alias("h"), "weight", "vec")
    for level in range(max_levels):
        members = staged(members, "members")
        sizes = staged(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > limit), "sizes")
        if sizes.isEmpty():
            return members
        wide = overlap if level == 0 else min(2, overlap)
        kids = F.least(F.lit(fan), F.ceil(2 * wide * F.col("n") / limit)).cast("int")
        held = members.join(sizes.withColumn("kids", kids), "shard")
        share = F.pmod(F.xxhash64(F.lit(level), "key"), F.lit(1 << 30)) / F.lit(1 << 30)

        def seeds(table):
            x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64)
            x = x.reshape(table.num_rows, -1)
            k = min(table.column("kids")[0].as_py(), len(x))
            x = x[np.argsort(table.column("h").to_numpy())]
            cent = x[:k]
            for _ in range(4):
                who = (x @ cent.T).argmax(axis=1)
                total = np.zeros_like(cent)
                np.add.at(total, who, x)
                size = np.linalg.norm(total, axis=1)
                cent = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], cent)
            return pa.table({"shard": table.column("shard")[:1], "seeds": pa.array([cent.tobytes()], pa.binary())})

        fitted = staged(held.where(share < F.col("kids") * PER_SEED / F.col("n")).select("shard", "kids", "h", "vec")
                        .groupBy("shard").applyInArrow(seeds, "shard long, seeds binary"), "seeds")
        salts = F.floor(F.col("n") / (16 * limit)).cast("int") + 1
        first = fitted.join(sizes, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("role"), F.lit("").alias("key"),
            F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("weight"), F.col("seeds").alias("vec"))
        rest = held.select("shard", F.pmod(F.xxhash64("h", F.lit(level)), salts).cast("int").alias("salt"), F.lit(1).alias("role"), "key", "h",
                           "weight", "vec")
        rows = first.unionByName(rest).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role")

        def assign(batches, wide=wide):
            run, cent = None, None
            for b in batches:
                heads = list(zip(*(b.column(k).to_pylist() for k in range(3))))
                cuts = [0, *[i for i in range(1, len(heads)) if heads[i] != heads[i - 1]], len(heads)]
                for a, z in zip(cuts[:-1], cuts[1:]):
                    part = b.slice(a, z - a)
                    if a == z:
                        continue
                    if heads[a][2] == 0:
                        run, cent = heads[a][:2], part.column("vec")[0].as_py()
                        continue
                    if heads[a][:2] != run:
                        raise RuntimeError("a shard without seeds")
                    vec = part.column("vec").to_pylist()
                    x = np.frombuffer(b"".join(vec), np.float64).reshape(len(vec), -1)
                    cos = x @ np.frombuffer(cent, np.float64).reshape(-1, x.shape[1]).T
                    most = min(wide, cos.shape[1])
                    kid = np.argpartition(-cos, most - 1, axis=1)[:, :most].ravel()
                    take = pa.array(np.repeat(np.arange(len(vec)), most), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("shard").take(take), pa.array(kid.astype(np.int32)),
                                                      *(part.column(c).take(take) for c in ("key", "h", "weight", "vec"))],
                                                     names=["shard", "kid", "key", "h", "weight", "vec"])

        split = (rows.mapInArrow(assign, "shard long, kid int, key string, h long, weight long, vec binary")
                 .withColumn("shard", F.xxhash64("shard", F.lit(level), "kid")).drop("kid")
                 .dropDuplicates(["shard", "key"]))
        members = members.join(F.broadcast(sizes) if level == 0 else sizes, "shard", "left_anti").unionByName(split)
    raise RuntimeError(f"a shard stays above {limit} nodes after {max_levels} levels")


def shard_links(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, found) and (a, b) links of the nodes of the shards."""

    def graph(table):
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(table.num_rows, -1)
        h = table.column("h").to_numpy()
        adj = flatgraph.build(x.astype(np.float32))
        lists = [h[a[a >= 0]].tobytes() for a in adj]
        return pa.table({"key": table.column("key"), "shard": table.column("shard"), "near": pa.array(lists, pa.binary())})

    # united lists of a node, and the shards that hold it (both bounded by its copies)
    lists = (members.groupBy("shard").applyInArrow(graph, "key string, shard long, near binary")
             .groupBy("key").agg(F.array_sort(F.collect_list("shard")).alias("homes"), F.collect_list("near").alias("near")))
    lists = staged(lists, "lists")

    def find(table):
        n = table.num_rows
        table = table.sort_by("key")
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(n, -1)
        single = x.astype(np.float32)
        h, shard = table.column("h").to_numpy(), table.column("shard")[0].as_py()
        order = np.argsort(h)
        near = [np.frombuffer(b"".join(v), np.int64) for v in table.column("near").to_pylist()]
        row, to = np.repeat(np.arange(n), [len(v) for v in near]), np.concatenate(near) if n else np.zeros(0, np.int64)
        at = order[np.minimum(np.searchsorted(h[order], to), n - 1)]
        pairs = np.unique(np.stack([row, at], 1)[(h[at] == to) & (row != at)], axis=0)       # members of this shard only
        degree = np.bincount(pairs[:, 0], minlength=n)
        adj = np.full((n, max(1, int(degree.max(initial=0)))), -1)
        adj[pairs[:, 0], np.arange(len(pairs)) - np.repeat(np.cumsum(degree) - degree, degree)] = pairs[:, 1]
        hit = np.zeros((n, n), bool)
        start = np.full((n, 1), flatgraph.medoid(single))
        for a in range(0, n, ROWS):
            hit[a:a + ROWS] = flatgraph.search(single, adj, single[a:a + ROWS], start[a:a + ROWS], within=threshold - 1e-5)[2]
        hit |= hit.T
        homes = table.column("homes").to_pylist()
        wide = max(map(len, homes))
        homes = np.array([v + v[:1] * (wide - len(v)) for v in homes], np.int64)
        weight, found, label = table.column("weight").to_numpy(), np.zeros(n, np.int64), np.arange(n)
        ends = []
        for a in range(0, n, 64):
            i, j = np.nonzero(hit[a:a + 64])
            i = i + a
            up = j > i
            i, j = i[up], j[up]
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold                                # in double
            i, j = i[ok], j[ok]
            shared = (homes[i][:, :, None] == homes[j][:, None, :]).any(axis=2)
            here = homes[i, shared.argmax(axis=1)] == shard                                   # first shard of both
            i, j = i[here], j[here]
            np.add.at(found, i, weight[j])
            np.add.at(found, j, weight[i])
            ends.append(np.stack([i, j]))
        i, j = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), int)
        while True:
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = low[low]
            if (low == label).all():
                break
            label = low
        keys = table.column("key").combine_chunks()
        some = np.flatnonzero(found)
        return pa.table({"key": keys.take(pa.array(some, pa.int64())), "found": pa.array(found[some]),
                         "b": keys.take(pa.array(label[some], pa.int64()))})

    out = staged(members.join(lists, "key").groupBy("shard").applyInArrow(find, "key string, found long, b string"), "found")
    return out.select("key", "found"), out.where("key <> b").select(F.col("key").alias("a"), "b")


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, most: int) -> float:
    """Share of the true links of ``most`` nodes that were counted: the lower of
    the share of all links and the mean over these nodes."""
    asked = nodes.orderBy(F.xxhash64(F.lit(7), "key"), "key").limit(most).select("key", "dims", "weight", "vec")
    asked = {r.key: r for r in asked.collect()}
    if not asked:
        return 1.0
    got = {r.key: r.n for r in counted.where(F.col("key").isin(list(asked))).collect()}
    by_dims = {}
    for k, r in asked.items():
        by_dims.setdefault(r.dims, []).append((k, r.vec))
    stacks = {d: (np.frombuffer(b"".join(v for _, v in rows), np.float64).reshape(-1, d), [k for k, _ in rows]) for d, rows in by_dims.items()}

    def count(batches):
        total = {d: np.zeros(len(k), np.int64) for d, (_, k) in stacks.items()}
        for b in batches:
            dims = np.asarray(b.column("dims"))
            for d in np.unique(dims).tolist():
                if d in stacks:
                    part = b.filter(pa.array(dims == d))
                    total[d] += (stacks[d][0] @ _stack(part.column("vec"), d).T >= threshold) @ part.column("weight").to_numpy()
        for d, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(stacks[d][1], pa.string()), pa.array(n)], names=["key", "n"])

    true = {r.key: r.n - 1 for r in nodes.select("dims", "weight", "vec").mapInArrow(count, "key string, n long")
            .groupBy("key").agg(F.sum("n").alias("n")).collect()}
    linked = [(min(got[k], n), n) for k, n in true.items() if n > 0]
    if not linked:
        return 1.0
    return min(sum(g for g, _ in linked) / sum(n for _, n in linked), sum(g / n for g, n in linked) / len(linked))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                           rho: float = RHO, limit: int = LIMIT, fan: int = FAN, overlap: int = OVERLAP, core_min: int = CORE_MIN,
                           sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audited_recall."""
    link, core = float(np.arccos(threshold)), float(np.arccos(rho))
    if 2 * core >= link:
        raise ValueError("members of a core must link: 2 * arccos(rho) < arccos(threshold)")
    ready(vectors.sparkSession)
    rows = staged(unit_rows(vectors, id_col, vec_col), "units")
    nodes = staged(rows.where("key is not null").groupBy("key").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("dims").alias("dims"), F.first("vec").alias("vec")), "nodes")
    by_dims = {}
    for r in nodes.orderBy(F.xxhash64("key"), "key").limit(sample).select("dims", "vec").collect():
        by_dims.setdefault(r.dims, []).append(r.vec)
    pivots, base = {}, 0
    for d, vecs in sorted(by_dims.items()):
        p = fit_pivots(np.frombuffer(b"".join(vecs), np.float64).reshape(-1, d), rho, core_min, CORES - base)
        pivots[d], base = (base, p), base + len(p)
    placed = staged(place(nodes, pivots, link, core), "placed")
    with_cores = against_cores(placed, threshold) if base else None
    single = placed.where("core is null")
    for attempt in range(ATTEMPTS):
        found, links = shard_links(cluster_shards(single, limit, fan, overlap << attempt), threshold)
        if with_cores:
            found, links = found.unionByName(with_cores[0]), links.unionByName(with_cores[1])
        found = found.groupBy("key").agg(F.sum("found").alias("found"))
        counted = staged(nodes.join(found, "key", "left")
                         .select("key", (F.col("weight") - 1 + F.coalesce("found", F.lit(0))).alias("n")), "counted")
        recall = audit(nodes, counted, threshold, AUDIT)
        if recall >= RECALL:
            break
    comps = connected_components(links)
    named = (placed.select("key", F.coalesce(core_name(F.col("core")), F.col("key")).alias("node")).join(comps, "node", "left")
             .select("key", F.coalesce("component", "node").alias("component")))
    named = staged(named.join(nodes.select("key", "least"), "key"), "named")
    least = staged(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    info = staged(named.join(least, "component").join(counted, "key").select("key", "component_id", "n"), "info")
    dealt = (rows.where("key is not null").select("vec_id", "key").join(info, "key").select("vec_id", F.col("n").alias("n_links"), "component_id")
             .unionByName(rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))))
    return (dealt.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
            .withColumn("audited_recall", F.lit(recall)))
