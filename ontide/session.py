"""Session settings and the shared staging folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on. AQE coalesces small shuffles, splits the hot side of a
# skewed join and turns a shuffle join into a broadcast join only when the measured
# size of one side is below the threshold.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "ontide", **conf: str) -> SparkSession:
    """A session with the recommended settings; keyword `conf` uses `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="ontide-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


# Removes an execution's shuffle files when it ends, instead of when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Paths staged inside each open `stage_scope`.
_SCOPES: list[list[str]] = []


def staged_path(spark: SparkSession) -> str:
    """A new path in the application's staging folder; an open `stage_scope` removes it."""
    path = f"{shared_dir(spark)}/ontide-stage/{spark.sparkContext.applicationId}/{uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Operators that read their input more than once stage it first. It saves the
    recomputation, it survives the loss of executors, and it keeps the passes consistent:
    a floating-point mean may differ in its last digit from one evaluation of a shuffle
    to the next. The files lie under the application's id, so they can be removed once
    the application has ended; inside a `stage_scope` they go when it closes.

    The write's shuffle files go as soon as it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = staged_path(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged inside; nothing that reads it may be returned."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for name in _SCOPES.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
