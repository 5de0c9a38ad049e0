"""Sharding by balanced label propagation.

Documents that share a link key (by default: equal texts) are neighbours.  The
label of a document is its shard.  It starts from a hash; then, round by
round, the labels of every key's documents are summed (bytes by label, partial
aggregation), and each key asks for one shard, to which its documents in other
shards ask to move.  In even rounds that is the shard with most of its bytes; in
odd ones, those come first whose free bytes hold the rest of the key, so that a
key which a full shard refused tries the next best one.

A shard takes in what it has free (its capacity, an even share of all bytes,
less what linked documents hold) and what leaves it in the same round
(``flows``), and of each pair of shards' documents the first ones in an order of keys, drawn anew every round,
move.  Keys larger than a shard come after all others: such a key fills a shard
and keeps the rest where it is, so capacity wins over links.  Rounds go on until
no key is split or two in a row bring no more bytes together (``rounds`` can end
them sooner).

Documents without links then fill what is left of each shard, laid along the
line of free bytes in hash order: first the large ones, then those of at most
1/256 of a shard, so that shards differ by about one small document.  (With
so many linked bytes that a shard is full, it gets none.)

Running sums are taken over digit groups of a hash (``tables.running_sum``),
never over a shard in one task.  Texts stay in the scan: rows are (id, size,
checksum, key).  Each round is a staged table.

The law is ``bytes``.  Size is UTF-8 bytes plus 1.  Null and empty texts have
no link; a null id is an id like any other; rows are placed one by one, so a
repeated row is a document of its own (and linked with its copy); other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import running_sum, staged

SHARDS = 8


def document_rows(docs: DataFrame, id_col: str, text_col: str, link: Column | None) -> DataFrame:
    text = F.col(text_col).cast("string")
    known = F.when(F.octet_length(text) > 0, F.xxhash64(text))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                       (known if link is None else link).alias("key"), F.coalesce(known, F.lit(0)).alias("t"))
    return rows.withColumn("u", F.xxhash64(F.lit("shard"), "doc_id", "t")).drop("t")


def digits(x: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(x), 64 - bits).cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text", link: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless
    from 0 within the shard)."""
    rows = staged(document_rows(docs, id_col, text_col, link), "rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    keys = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = staged(keys, "keys")
    linked = staged(rows.join(keys, "key").withColumn("label", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int"))
                    .select("doc_id", "size", "text_crc32", "key", "u", "label"), "linked")
    together, idle, turn, kept = -1, 0, 0, linked
    while rounds is None or turn < rounds:
        load = {r["label"]: r["b"] for r in linked.groupBy("label").agg(F.sum("size").alias("b")).collect()}  # a row per shard
        room = [total // shards - load.get(s, 0) for s in range(shards)]
        best = staged(targets(linked, room, total // shards, turn % 2 == 1), "best")  # the join can be split at hot keys
        held = best.agg(F.coalesce(F.sum("most"), F.lit(0))).first()[0]
        together, idle, kept = (held, 0, linked) if held > together else (together, idle + 1, kept)
        if idle == 2:
            linked = kept
            break
        asked = linked.join(best.drop("most"), "key")
        movers = asked.where("best <> label")
        wants = {(r["giant"], r["label"], r["best"]): r["b"] for r in movers.groupBy("giant", "label", "best")
                 .agg(F.sum("size").alias("b")).collect()}               # two rows per pair of shards
        if not wants:
            break
        quota = [flows({k[1:]: b for k, b in wants.items() if k[0] == giant}, room) for giant in (False, True)]
        limit = F.get(F.array(*[F.lit(q.get((a, b), 0)).cast("long") for q in quota for a in range(shards) for b in range(shards)]),
                      (F.col("giant").cast("int") * shards + F.col("label")) * shards + F.col("best"))
        movers = (movers.withColumn("v", F.xxhash64(F.lit("move"), F.lit(turn), "key"))
                  .withColumn("turn", F.shiftleft(digits("v", 12), 10).bitwiseOR(digits("u", 10))))
        moved = running_sum(movers, ["giant", "label", "best"], ["v", "u"], F.col("size"), "ahead", "turn").withColumn(
            "label", F.when(F.col("ahead") + F.col("size") <= limit, F.col("best")).otherwise(F.col("label")))
        linked = staged(asked.where("best = label").select(linked.columns).unionByName(moved.select(linked.columns)), "linked")
        turn += 1
    placed = linked.select("doc_id", "size", "text_crc32", "u", F.col("label").alias("shard"))
    single = rows.join(keys, "key", "left_anti").select("doc_id", "size", "text_crc32", "u")
    large = F.col("size") > total // shards // 256
    for part in (single.where(large), single.where(~large)):
        placed = staged(placed.unionByName(laid_out(staged(part, "singles"), placed, total, shards)), "placed")
    slots = running_sum(placed.withColumn("turn", digits("u", 12)), ["shard"], ["u", "doc_id"], F.lit(1), "slot", "turn")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def targets(linked: DataFrame, room: list[int], capacity: int, whole: bool) -> DataFrame:
    """(key, best, most, giant): the shard that each key asks for, the bytes of
    the key that lie together, and whether the key is larger than a shard.
    With ``whole`` shards come first whose free bytes hold the rest of the key."""
    held = (linked.groupBy("key", "label").agg(F.sum("size").alias("bytes"))
            .groupBy("key").agg(F.sum("bytes").alias("all"), F.max("bytes").alias("most"),
                                F.map_from_entries(F.collect_list(F.struct("label", "bytes"))).alias("of")))  # an entry per shard
    choice = []
    for s, free in enumerate(room):
        there = F.coalesce(F.try_element_at("of", F.lit(s)), F.lit(0)).cast("long")
        fits = (F.col("all") - there <= max(0, free)) if whole else F.lit(False)
        choice.append(F.struct(fits.alias("fits"), there.alias("bytes"), F.lit(-s).alias("l")))
    return held.withColumn("x", F.array_max(F.array(*choice))).select(
        "key", (-F.col("x.l")).alias("best"), "most", (F.col("all") > capacity).alias("giant"))


def flows(wants: dict, room: list[int]) -> dict:
    """Bytes that may move between each pair of shards, so that what comes in
    fits what is free and what goes out; ``room`` is brought up to date.  First
    pairs change places, then cycles (what is still wanted, scaled down by the
    receiving shard until it fits), then free bytes are handed on."""
    shards, flow, left = range(len(room)), dict.fromkeys(wants, 0), dict(wants)

    def move(a: int, b: int, x: int) -> None:
        flow[a, b] += x
        left[a, b] -= x
        room[a] += x
        room[b] -= x

    for a, b in wants:
        if a < b:
            x = min(left[a, b], left.get((b, a), 0))
            if x:
                move(a, b, x)
                move(b, a, x)
    scaled = {k: float(b) for k, b in left.items()}
    for _ in range(1000):
        over = 0.0
        for b in shards:
            into = sum(x for (_, t), x in scaled.items() if t == b)
            may = max(0.0, room[b] + sum(x for (a, _), x in scaled.items() if a == b))
            if into > may:
                over = max(over, into - may)
                scaled.update({k: x * may / into for k, x in scaled.items() if k[1] == b})
        if over < 1:
            break
    for (a, b), x in scaled.items():
        move(a, b, int(x))
    for _ in range(1000):
        open_ = [(a, b) for a, b in wants if left[a, b] > 0 and room[b] > 0]
        if not open_:
            break
        for a, b in open_:
            move(a, b, max(0, min(left[a, b], room[b])))
    return flow


def laid_out(rows: DataFrame, placed: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` with a shard: laid along the line of bytes that are free."""
    load = {r["shard"]: r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}  # a row per shard
    bytes_ = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    room = [max(0.0, total / shards - load.get(s, 0)) for s in range(shards)]
    edges = [sum(room[:s + 1]) * bytes_ / (sum(room) or 1) for s in range(shards)]
    shard = F.lit(max((s for s in range(shards) if room[s] > 0), default=shards - 1))
    for s in reversed(range(shards - 1)):
        if room[s] > 0:
            shard = F.when(F.col("ahead") + F.col("size") / 2 < edges[s], F.lit(s)).otherwise(shard)
    line = running_sum(rows.withColumn("turn", digits("u", 12)), [], ["u", "doc_id"], F.col("size"), "ahead", "turn")
    return line.select("doc_id", "size", "text_crc32", "u", shard.cast("int").alias("shard"))
