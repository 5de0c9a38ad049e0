"""Session helpers: shared scratch root and shipping the package to workers."""

import os

import pandas as pd

from tessera.session import _SHIPPED, scratch_path, shared_root, ship_package


def test_shared_root_uses_the_configured_checkpoint_dir(spark):
    root = shared_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root)


def test_workers_import_the_package(spark):
    ship_package(spark)
    ship_package(spark)                        # idempotent per application
    assert spark.sparkContext.applicationId in _SHIPPED

    def probe(batches):
        for pdf in batches:
            import tessera
            yield pd.DataFrame({"where": [os.path.basename(os.path.dirname(tessera.__file__))] * len(pdf)})

    rows = spark.range(4).mapInPandas(probe, "where string").distinct().collect()
    assert [r["where"] for r in rows] == ["tessera"]
