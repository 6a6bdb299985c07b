"""Session builder for tests, the bench and stand-alone jobs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from newsgraph.sinks.key_layout import PUSHED_KEYS


def build(app: str = "newsgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume.

    On a cluster the submit command names the master and the shuffle
    parallelism; only settings that matter for results or for skew are set here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # the key hashes of a batch reach the row groups and bloom filters of the stored tables
        .config("spark.sql.parquet.pushdown.inFilterThreshold", str(PUSHED_KEYS))
    )
    builder = builder.config(
        # keyed state of the stream on local disk instead of the heap of the executors
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> str:
    """Give the Python workers of all executors this package; returns its archive.

    Functions that run in tasks are found by name there. A job that does not use
    ``build`` calls this itself, or passes the archive as ``--py-files``.
    """
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="newsgraph-ship-")) / "newsgraph.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    return str(target)
