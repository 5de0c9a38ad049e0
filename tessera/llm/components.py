"""Connected components of a link table by iterated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node
    reachable.  Large-star / small-star rounds; every round's edges are a
    staged table, and a node with very many neighbours is met by joins that
    adaptive execution can split, never by one group.

    Null ends and self-links are left out; repeated links count once."""
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .where("u is not null and v is not null and u <> v").distinct())
    e = staged(e, "edges")
    state = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the node's least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
        # small star: a node and its smaller neighbours link to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct())
        e = staged(e, "edges")
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                                                        F.lit(0)).alias("h")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
