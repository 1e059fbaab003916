"""Matching: from a view, a query and a threshold to mappings, by any strategy."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mappings import m
from ..operators import candidates
from ..operators.graph import GraphView
from ..operators.stats import PlanStatistics
from ..shared import write_shared
from .branch import Branches
from .config import MatchConfig
from .enumerate import enumerate_all
from .index import index_candidates
from .lattice import Matcher, fragment, lattice
from .query import QueryGraph


def plan(g: GraphView, q: QueryGraph, threshold: int, config: MatchConfig) -> Branches | DataFrame:
    spark, stats = g.vtx.sparkSession, PlanStatistics(g, q)
    if any(n < q.labels.count(x) for x, n in zip(q.labels, stats.vertices, strict=True)):  # a label that the data lack or hold too seldom, as in a query larger than the data: no mapping
        return spark.createDataFrame([], ", ".join([*(f"{m(u)} long" for u in range(q.size)), "missing int"]))
    if config.strategy in ("branch", "tree"):
        cand = write_shared(spark, candidates.pipeline(g, q, threshold, config.bridge_filter, config.spoke_filter), "candidates")[0] if config.candidates else None
        return Branches(g, q, threshold, config, stats.weight, stats.size_of, cand)
    if config.strategy in ("lattice", "fragment"):
        return {"lattice": lattice, "fragment": fragment}[config.strategy](g, q, threshold, Matcher(g, q, stats.size_of, stats.selectivity))
    order = q.match_order(q.edges, stats.size_of)
    if config.strategy == "index":
        cand = write_shared(spark, index_candidates(g, q, threshold), "candidates")[0]
        return enumerate_all(g, q, threshold, order, {u: cand.where(F.col("u") == u).select(F.col("vid").alias(m(u))) for u in range(q.size)})
    return enumerate_all(g, q, threshold, order, {u: g.with_label(q.labels[u], m(u)) for u in range(q.size)})


def match(g: GraphView, q: QueryGraph, threshold: int, config: MatchConfig = MatchConfig()) -> DataFrame:
    """``m0 .. m{k-1}, missing``: all mappings, at most ``config.limit`` of them if it is set."""
    made = plan(g, q, threshold, config)
    rows = made.plan() if isinstance(made, Branches) else made
    return rows if config.limit is None else rows.limit(config.limit)


def match_counts(g: GraphView, q: QueryGraph, threshold: int, config: MatchConfig = MatchConfig()) -> DataFrame:
    """``missing, matches``: counted without expanding deferred vertices where the plan has them."""
    made = plan(g, q, threshold, config)
    if isinstance(made, Branches):
        return made.count()
    return made.groupBy("missing").agg(F.count(F.lit(1)).alias("matches"))
