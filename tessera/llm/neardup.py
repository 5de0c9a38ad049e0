"""Near-duplicate documents: MinHash banding with sequential Bayesian verification.

1. Every text becomes the set of its distinct ``shingle``-word runs and a
   MinHash signature.  Texts with equal sets are one class (digest of the
   set), represented by its smallest id, so copies never meet pairwise.
2. Band keys put class representatives into buckets; each member of a bucket
   is a candidate with the bucket's smallest member (its pivot).
3. Candidates are compared signature batch by batch.  After n hashes with m
   matches the posterior of the similarity is Beta(m + 1, n - m + 1) (uniform
   prior); a pair is dropped once P(similarity >= threshold) < ``miss``.
4. Survivors are verified exactly on their full sets, and only these confirmed
   links count.  The pivot's text streams past its members' texts, in salted
   runs, so a pivot of very many members is spread over tasks.
5. Components.  A bucket whose members are by then in one component is done.
   In the others the members of different components are compared with each
   other, in blocks of about ``BLOCK`` members, with the same bounds; survivors
   are verified within the block and only links that join two of its
   components come out.

A pair at the threshold shares no band with probability
(1 - threshold**rows)**bands = 5e-6 with the defaults (32 bands of 4).

Words: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer than
``shingle`` words has its whole sequence as one shingle; null and empty texts
have an empty set and link with nothing.  Rows that share an id are one
document and count as linked.  Rows with a null id come back with a null
component and ``kept`` true.  Set elements are 64-bit hashes.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import SPACED, constants, mix, row_shingles, slices, utf8, words
from .tables import matching, ready, staged, without

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 32, 4, 75
BATCH, MISS, BLOCK, BLOCK_SIZE, SALT = 16, 1e-6, 512, 4_000_000, 64


def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> list[int]:
    """For each number of compared hashes the least matches that keep a pair:
    P(s >= threshold | m of n) = P(Binomial(n + 1, threshold) <= m)."""
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, hashes: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): set size, 128-bit digest of the set
    and the signature (``hashes`` little-endian 32-bit values; null: no set)."""
    ready(docs.sparkSession)

    def sign(batches):
        mul = (constants(hashes, 23) >> np.uint64(20)).astype(np.uint32) | np.uint32(1)
        add = (constants(hashes, 29) >> np.uint64(13)).astype(np.uint32)
        for b in slices(batches, 1):
            data, off = utf8(b.column(1))
            h, woff = words(data, off, SPACED)
            sizes, d1, d2, sigs = [], [], [], []
            for s in row_shingles(h, woff, shingle):
                sizes.append(len(s))
                if not len(s):
                    d1.append(None), d2.append(None), sigs.append(None)
                    continue
                d1.append(int(np.add.reduce(mix(s)).view(np.int64)))
                d2.append(int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A))).view(np.int64)))
                x = (s >> np.uint64(32)).astype(np.uint32)
                low = None
                for i in range(0, len(x), 2048):
                    part = (x[i:i + 2048, None] * mul + add).min(axis=0)
                    low = part if low is None else np.minimum(low, part)
                sigs.append(low.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def similar(pairs: DataFrame, nodes: DataFrame, hashes: int, threshold: float, miss: float) -> DataFrame:
    """Candidates (a, b) whose posterior stays above the bound batch by batch."""
    least = least_matches(hashes, BATCH, threshold, miss)

    def compare(batches):
        for b in batches:
            x, y = (np.frombuffer(utf8(b.column(k))[0], np.uint32).reshape(-1, hashes) for k in (2, 3))
            live, got = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, need in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                got[live] += (x[live, cut] == y[live, cut]).sum(axis=1)
                live = live[got[live] >= need]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).take(pa.array(live))

    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
            .mapInArrow(compare, "a long, b long"))


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= percent * |union| on the full
    sets.  ``b`` is the pivot: its sets are held while its members stream by."""
    n = pairs.groupBy("b").agg(F.count("*").alias("n"))
    runs = (pairs.join(n, "b")
            .select("a", "b", F.when(F.col("n") > SALT, F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / SALT)))
                    .otherwise(F.lit(0)).alias("salt")))
    runs = staged(runs, "runs")
    members = runs.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), "salt", F.lit(1).alias("role"))
    pivots = runs.select(F.col("b").alias("doc_id"), F.col("b").alias("pivot"), "salt", F.lit(0).alias("role")).distinct()
    both = members.unionByName(pivots)
    rows = (both.join(matching(docs, F.col("doc_id"), both.select("doc_id")), "doc_id")
            .select("pivot", "salt", "role", "doc_id", "text")
            .repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role"))

    def confirm(batches):
        run, held = None, []
        for b in slices(batches, 4):
            keys = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            data, off = utf8(b.column(4))
            h, woff = words(data, off, SPACED)
            links = []
            for (pivot, salt, role, doc), s in zip(keys, row_shingles(h, woff, shingle)):
                if (pivot, salt) != run:
                    run, held = (pivot, salt), []
                if role == 0:
                    held.append(s)
                elif any(linked(s, p, percent) for p in held):
                    links.append((doc, pivot))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(confirm, "a long, b long")


def linked(s: np.ndarray, p: np.ndarray, percent: int) -> bool:
    if len(s) > len(p):
        s, p = p, s
    if not len(s) or 100 * len(s) < percent * len(p):
        return False
    at = np.searchsorted(p, s)
    at[at == len(p)] = 0
    both = int((p[at] == s).sum())
    return 100 * both >= percent * (len(s) + len(p) - both)


def crossing(bands: DataFrame, comps: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, hashes: int, rows: int,
             percent: int, miss: float) -> DataFrame:
    """Confirmed links (a, b) between members of different components in buckets
    that hold several, beside those with the pivot (which have been compared)."""
    least = least_matches(hashes, BATCH, percent / 100, miss)
    held = (bands.join(comps.withColumnRenamed("component", "comp"), "node", "left")
            .withColumn("comp", F.coalesce("comp", "node"))).join(nodes.select("node", "n_shingles"), "node")
    split = (held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"),
                                     F.sum("n_shingles").alias("size"), F.min("node").alias("pivot"))
             .where("lo <> hi and n > 2")
             .select("key", "pivot", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SIZE)).cast("int").alias("blocks")))
    member = (held.join(split, "key")
              .withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", "band", "pivot", "node", "comp", "mine", F.least("mine", "other").alias("i"),
                      F.greatest("mine", "other").alias("j")))
    member = staged(member, "members")
    texts = matching(docs, F.col("doc_id"), member.select("node")).withColumnRenamed("doc_id", "node")
    dealt = (member.join(nodes.select("node", "sig"), "node").join(texts, "node")
             .select("key", "i", "j", "band", "pivot", "mine", "node", "comp", "sig", "text")
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))

    def links_of(i, j, band, pivot, part):
        mine, node, comp = (np.array([x[k] for x in part], np.int64) for k in (0, 1, 2))
        sig = np.frombuffer(b"".join(x[3] for x in part), np.uint32).reshape(-1, hashes)
        sets = [x[4] for x in part]
        for x in (range(len(node)) if i == j else np.flatnonzero(mine == i).tolist()):
            ok = (comp != comp[x]) & (node != pivot) & (node[x] != pivot)
            ok &= node > node[x] if i == j else mine == j
            live = np.flatnonzero(ok)
            got = np.zeros(len(live), np.int64)
            for k, need in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                got += (sig[live, cut] == sig[x, cut]).sum(axis=1)
                live, got = live[got >= need], got[got >= need]
            if band and len(live):           # a pair belongs to the first band that it shares
                same = (sig[live, :band * rows] == sig[x, :band * rows]).reshape(len(live), band, rows).all(axis=2)
                live = live[~same.any(axis=1)]
            for y in live.tolist():
                if comp[x] != comp[y] and linked(sets[x], sets[y], percent):
                    comp[comp == comp[y]] = comp[x]      # one link joins the two here
                    yield int(max(node[x], node[y])), int(min(node[x], node[y]))

    def compare(batches):
        run, part = None, []
        pairs = lambda out: pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for b in slices(batches, 9):
            out = []
            h, woff = words(*utf8(b.column(9)), SPACED)
            for s, key, i, j, band, pivot, *rest in zip(row_shingles(h, woff, shingle), *(b.column(k).to_pylist() for k in range(9))):
                if run is None or (key, i, j) != run[:3]:
                    if part:
                        out.extend(links_of(*run[1:], part))
                    run, part = (key, i, j, band, pivot), []
                part.append([*rest, s])
            yield pairs(out)
        if part:
            yield pairs(list(links_of(*run[1:], part)))

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def same_id(sized: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    least = sized.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b <> z")
    return sized.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    hashes, threshold = bands * rows, percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(signatures(docs, id_col, text_col, shingle, hashes), "signatures")
    sets = signed.where("sig is not null and doc_id is not null")
    # tables of their own: joins with them can be split at hot keys
    classes = staged(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "nodes")
    sized = (sets.join(classes, ["d1", "d2"])
             .select("doc_id", "node", "n_shingles", F.when(F.col("doc_id") == F.col("node"), F.col("sig")).alias("sig")))
    sized = staged(sized, "classes")
    nodes = sized.where("sig is not null").select("node", "n_shingles", "sig")
    keyed = nodes.select("node", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * (4 * rows) + 1, F.lit(4 * rows))))).alias("band", "key"))
    shared = (keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
              .where("pivot <> last").select("key", "pivot"))
    held = staged(keyed.join(staged(shared, "shared"), "key").select("key", "band", "node", "pivot"), "bands")
    pairs = held.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = staged(verified(similar(pairs, nodes, hashes, threshold, miss), texts, shingle, percent)
                   .unionByName(same_id(sized)), "links")
    comps = connected_components(links)
    more = staged(crossing(held.select("key", "band", "node"), comps, nodes, texts, shingle, hashes, rows, percent, miss), "links")
    if not more.isEmpty():
        comps = connected_components(links.unionByName(more))
    label = (sized.select("doc_id", "node").join(comps, "node", "left")
             .select("doc_id", F.coalesce("component", "node").alias("component")))
    least = label.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    return (signed.select("doc_id", "n_shingles").join(least, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns as they were, one of each component (the one
    with the smallest id; rows with a null id stay)."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select("doc_id")
    return without(docs, F.col(id_col).cast("long"), gone)
