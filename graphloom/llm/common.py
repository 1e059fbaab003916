"""Shared plumbing: shipping the package, size-checked broadcasts; scratch tables come from ``graphloom.shared``."""
from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_shared, scratch_path, write_shared  # noqa: F401  (operators take these from here)

ROOT = Path(__file__).resolve().parents[2]
#: Rows up to which a narrow side (keys and a few numbers) is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of a row of keys and a few numbers, where ``write_shared`` is told a size.
ROW_BYTES = 80
#: Bytes of an Arrow batch between the JVM and a Python worker where ``small_batches`` holds; one row may be larger.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor the working folder gives it."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == str(ROOT) for p in known):
        return
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    import atexit
    import shutil
    import tempfile
    import zipfile

    tmp = tempfile.mkdtemp()  # the driver serves the file to executors until it ends
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    out = os.path.join(tmp, "graphloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "graphloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(out)
    sc._graphloom_shipped = True


def broadcast_if(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose row count was measured and lies within the bound; else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def small_batches(spark: SparkSession) -> str:
    """Lower the session's bound on Arrow batches, which both sides hold whole, to ``BATCH_BYTES``; returns the bound before.

    It is read when a lazy result runs, so it stays until the caller sets it back.
    """
    before = spark.conf.get(BATCH_KEY)
    if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return before
