"""Written intermediate tables.

A frame that is read more than once, or whose row numbering must not change
between two passes, is written to the shared folder named by
``spark.checkpoint.dir`` and read back. That cuts the lineage, survives the
loss of executors and gives the next plan exact file sizes.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_local_roots: dict[str, str] = {}
_used: set[str] = set()
_active = threading.local()


def _scopes() -> list[list[str]]:
    """Open scopes of this thread, innermost last."""
    if not hasattr(_active, "scopes"):
        _active.scopes = []
    return _active.scopes


def staging_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _used:
        _used.add(app)
        atexit.register(release, spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="newsgraph-")
        base = _local_roots[app]
    return f"{base.rstrip('/')}/newsgraph/{app}"


def release(spark: SparkSession) -> None:
    """Drop everything this application has staged; runs at exit when the
    session is still up then."""
    if spark.sparkContext._jsc is not None:
        fs, target = hadoop_fs(spark, staging_root(spark))
        fs.delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes():
        _scopes()[-1].append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, name: str, counted: Column | None = None) -> tuple[DataFrame, int]:
    """``stage`` and the number of rows (where ``counted`` holds), counted by
    the write itself."""
    seen = Observation()
    one = F.lit(1) if counted is None else F.when(counted, F.lit(1))
    written = stage(df.observe(seen, F.count(one).alias("rows")), name)
    return written, seen.get["rows"]


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API for any supported scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Drop every table staged inside the block when the block ends."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            fs, target = hadoop_fs(spark, path)
            fs.delete(target, True)
