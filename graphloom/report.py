"""The report of one match: counts, stage times, peak memory, as a record, as lines and as a one-row table."""
from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import candidates
from .operators.graph import GraphView
from .operators.stats import PlanStatistics
from .plans.config import MatchConfig
from .plans.match import match
from .plans.query import QueryGraph
from .streaming.progress import watched


@dataclass
class MatchReport:
    """Fields that a strategy does not have are None and print as ``NA``."""

    algorithm: str
    count: int = 0
    load_ms: float = 0.0
    run_ms: float = 0.0
    total_ms: float = 0.0
    preprocessing_ms: float = 0.0
    search_ms: float = 0.0
    peak_rss_kb: int = 0
    filter_candidates: int | None = None
    recursion_calls: int | None = None
    requested_threshold: int = 0
    effective_threshold: int = 0
    output_limit: int = 0
    output_limit_reached: int = 0
    stats: dict = field(default_factory=dict)

    def line(self) -> str:
        """All fields but ``stats`` as one line of ``key=value``."""
        show = lambda v: "NA" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
        return "\t".join(["SUMMARY", *(f"{k}={show(v)}" for k, v in asdict(self).items() if k != "stats")])

    def table(self, spark: SparkSession) -> DataFrame:
        """One row; ``stats`` as a map of text."""
        row = {k: v for k, v in asdict(self).items() if k != "stats"} | {"stats": {k: str(v) for k, v in self.stats.items()}}
        kind = "algorithm string, count long, load_ms double, run_ms double, total_ms double, preprocessing_ms double, search_ms double, peak_rss_kb long, filter_candidates long, recursion_calls long, requested_threshold int, effective_threshold int, output_limit long, output_limit_reached int, stats map<string,string>"
        return spark.createDataFrame([row], kind)


@contextmanager
def timed(report: MatchReport, name: str) -> Iterator[None]:
    began = time.perf_counter()
    try:
        yield
    finally:
        setattr(report, name, getattr(report, name) + (time.perf_counter() - began) * 1000)


def run_match(g: GraphView, q: QueryGraph, threshold: int, config: MatchConfig = MatchConfig(), name: str | None = None, load_ms: float = 0.0) -> MatchReport:
    """Count all mappings and report how."""
    r = MatchReport(name or config.strategy, requested_threshold=threshold, effective_threshold=q.clamp(threshold), output_limit=config.limit or 0, load_ms=load_ms)
    with timed(r, "run_ms"):
        with timed(r, "preprocessing_ms"):
            g.typed.count()
            if config.candidates:
                r.filter_candidates = candidates.pipeline(g, q, threshold, config.bridge_filter, config.spoke_filter).count()
            stats = PlanStatistics(g, q)
            rows = match(g, q, threshold, config)
        with timed(r, "search_ms"):
            r.count = watched(rows, "matches").agg(F.count(F.lit(1))).first()[0]
    r.total_ms = r.load_ms + r.run_ms
    r.output_limit_reached = int(config.limit is not None and r.count >= config.limit)
    r.peak_rss_kb = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    r.stats = {"label_vertices": stats.vertices, "edge_rows": list(stats.pairs.values()), "bridges": len(q.bridges()), "cycle_rank": q.cycle_rank}
    return r
