"""Checkpoints of how many mappings a running match has made.

``Observation`` metrics are known when an action ends; for a running one, a listener thread reads the job's finished tasks.
"""
from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed checkpoints of results.
CHECKPOINTS = (10**6, 10**7, 10**8, 10**9)


def watched(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their count observed under ``name`` by any query listener."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


def reached(count: int) -> list[int]:
    """The checkpoints that a count has passed."""
    return [c for c in CHECKPOINTS if count >= c]


class Progress:
    """Call ``tell(done, total)`` every ``seconds`` with the finished and all tasks of the running stages."""

    def __init__(self, spark: SparkSession, tell: Callable[[int, int], None], seconds: float = 30.0):
        self.tracker, self.tell, self.seconds, self.over = spark.sparkContext.statusTracker(), tell, seconds, threading.Event()

    def __enter__(self) -> Progress:
        threading.Thread(target=self._run, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()

    def _run(self) -> None:
        while not self.over.wait(self.seconds):
            stages = [s for s in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if s]
            self.tell(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))
