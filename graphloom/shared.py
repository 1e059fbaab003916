"""Scratch tables in the folder that driver and executors share: lineage is cut by writing and reading again."""
from __future__ import annotations

import atexit
import math
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task should have at least, where a caller knows about how many a table takes.
FILE_BYTES = 8 << 20
#: Scratch tables that are still there; removed when the driver's Python ends.
_left: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a folder of our own only on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(sc, "_graphloom_shared", None)
        if not at:
            at = sc._graphloom_shared = f"file:/tmp/checkpoints/{uuid.uuid4().hex}"
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


def write_shared(spark: SparkSession, df: DataFrame, name: str, size: float | None = None) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    ``size``: about how many bytes the last step handles.  Its partitions are then put together into files of
    ``FILE_BYTES``, one a core at least: every file costs the store several calls, and on a local one processes.
    """
    path = scratch_path(spark, name)
    if size is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(size / FILE_BYTES)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that nothing reads any more."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), paths)


def _delete(jvm, conf, paths) -> None:
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        _left.discard(p)


@atexit.register
def _drop_left() -> None:
    """What lazy results still read until now: tables whose frames the caller may have used to the end."""
    jvm = SparkContext._jvm
    if not _left or jvm is None:
        return
    try:
        _delete(jvm, jvm.org.apache.hadoop.conf.Configuration(), list(_left))
    except Exception as e:  # the JVM may be gone before us; the folder is the cluster's to clean then
        print(f"graphloom: {len(_left)} scratch tables were left in the shared folder: {type(e).__name__}")
