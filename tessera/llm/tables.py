"""Staged tables and distributed prefix sums shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of an Arrow batch: with whole texts the session's default of 10,000
#: rows is tens of MB, on both sides and for every task.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and Arrow batches small
    enough for whole texts (a size that the user has set stays)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of 8-byte keys that are sent to every executor at most (16 MB).
BROADCAST_KEYS = 1_000_000


def matching(docs: DataFrame, key: Column, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs``, columns as they were, whose ``key`` (a long) is
    ("left_semi") or is not ("left_anti") in the one column of ``keys``.  The
    keys are counted: up to ``BROADCAST_KEYS`` they are broadcast and the texts
    stay where they are, beyond it both sides are exchanged."""
    left, right = unused(docs.columns, "key"), unused(docs.columns, "match")
    keys = keys.toDF(right)
    keys = staged(keys.where(keys[right].isNotNull()).distinct(), "keys")
    small = keys.count() <= BROADCAST_KEYS
    return (docs.withColumn(left, key)
            .join(F.broadcast(keys) if small else keys, F.col(left) == F.col(right), how).drop(left))


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in ``gone``."""
    return matching(docs, key, gone, "left_anti")


def unused(df_columns, name: str) -> str:
    """A column name that no column of the input has."""
    taken = {c.lower() for c in df_columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys come back once."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], order: list[str], weight: Column, out: str,
                bucket: str) -> DataFrame:
    """Exclusive running sum of ``weight`` within ``keys`` in the order
    (``bucket``, *order), without ever sorting one key in one task.

    ``bucket`` is a column of bounded range that agrees with the order (the
    leading digits of a uniform hash).  Bucket totals are summed with partial
    aggregation and accumulated over that small table; rows are only sorted
    within a (key, bucket)."""
    w, base = f"__w_{out}", f"__base_{out}"
    df = df.withColumn(w, weight)
    sums = (df.groupBy(*keys, bucket).agg(F.sum(w).alias(base))
            .withColumn(base, F.sum(base).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket)) - F.col(base)))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (meet(df, sums, [*keys, bucket])
            .withColumn(out, F.coalesce(F.sum(w).over(inside), F.lit(0)) + F.col(base)).drop(w, base))
