"""Deadlines for loading and for matching: a run's jobs are cancelled when its time is over."""
from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def within(spark: SparkSession, seconds: float | None, name: str, work: Callable[[], T]) -> T:
    """``work()`` with its Spark jobs in a group of their own, cancelled with ``TimeoutError`` after ``seconds``."""
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(name)

    timer = threading.Timer(seconds, stop) if seconds is not None else None
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"{name} took more than {seconds} s") from e
        raise
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
