"""Session helpers: a tuned builder for tests/bench and a shared scratch root."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Sizes that keep a shuffle partition in the low hundreds of MB at large scale;
# AQE coalesces them down on small inputs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's recommended settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt out over all cores.

    A Parquet file is split by row groups only, so a table in one row group is
    read, and all row-wise work on it done, by one task.  Tables below one full
    split (``spark.sql.files.maxPartitionBytes``) for each core are shuffled
    once; larger ones have splits enough and come back as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower().rstrip("b")
    split = int(split) if split.isdigit() else int(split[:-1]) << {"k": 10, "m": 20, "g": 30}[split[-1]]
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


#: Rows of an Arrow batch: with whole texts the session's default of 10,000 rows is
#: tens of MB, on both sides and for every task.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and Arrow batches small
    enough for whole texts (a size that the user has set stays)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """Directory shared by all executors for checkpoints and round-trip files.

    Uses ``spark.checkpoint.dir``.  Only where it is unset and driver and
    executors are one process (``local[...]``) a fresh directory under the
    system temp dir is made and registered; on a cluster that folder would be
    each machine's own, so there an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessera-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:  # noqa: BLE001 - some sessions reject core confs at runtime
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared root (never reused between runs)."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers (pandas UDFs and
    ``mapInPandas`` functions are pickled by reference to this package).

    The package is zipped once per application on the driver and handed to
    ``SparkContext.addPyFile``, which distributes it to every executor the
    same way ``--py-files`` does."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="tessera-pyfiles-")
    out = os.path.join(out_dir, "tessera.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
