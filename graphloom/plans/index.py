"""The synopsis index: vertices in nested blocks, each with its labels, its neighbours' labels and its largest degree.

Blocks hold about ``FAN`` vertices of one label and similar degree, and ``FAN`` blocks make one above; results do not
depend on them.  A query vertex descends from the top: a block stays if it may hold a vertex of the label with
enough neighbours (degree bound) of enough wanted labels (label bound), and its children are looked at next.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import GraphView
from ..shared import write_shared
from .query import QueryGraph

FAN = 16


def vertex_synopsis(g: GraphView, labels: tuple[str, ...] | None = None) -> DataFrame:
    """``vid, label, nlabels, degree``: own label, sorted distinct neighbour labels, degree; of all vertices or those of ``labels``."""
    own = lambda name: F.lit(True) if labels is None else F.col(name).isin(sorted(set(labels)))
    near = g.typed.where(own("sl")).groupBy(F.col("src").alias("vid")).agg(F.array_sort(F.collect_set("dl")).alias("nlabels"), F.count(F.lit(1)).alias("degree"))
    empty = F.array().cast("array<string>")
    return g.vtx.where(own("label")).join(near, "vid", "left").select("vid", "label", F.coalesce("nlabels", empty).alias("nlabels"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def blocks(synopses: DataFrame, fan: int = FAN) -> DataFrame:
    """``synopses`` with ``block``: vertices of one label and degree range dealt by a hash, about ``fan`` to a block.

    Nothing is sorted or numbered, so a label that most vertices have is spread like any other.
    """
    rows = synopses.withColumn("level", F.floor(F.log2(F.col("degree") + 1)).cast("long"))
    sizes = rows.groupBy("label", "level").agg(F.ceil(F.count(F.lit(1)) / fan).alias("n"))
    block = F.col("level") * F.lit(1 << 40) + F.pmod(F.xxhash64("vid"), F.col("n"))
    return rows.join(sizes, ["label", "level"]).withColumn("block", block).drop("level", "n")


def roll_up(rows: DataFrame, *by: str) -> DataFrame:
    """The synopsis of a group: all labels, all neighbour labels, the largest degree."""
    merged = rows.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("nlabels")))).alias("nlabels"), F.max("degree").alias("degree"))
    return merged


def majority_label(rows: DataFrame, by: str) -> DataFrame:
    """The most frequent label per group, the least one of equals."""
    n = rows.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"))


def _at(values: list[Column]) -> Column:
    return F.element_at(F.array(*values), F.col("u") + 1)


def degree_bound(q: QueryGraph) -> Column:
    """Edges that a vertex of ``degree`` must lack as query vertex ``u``."""
    return F.greatest(F.lit(0), _at([F.lit(q.degree(u)) for u in range(q.size)]) - F.col("degree"))


def label_bound(q: QueryGraph) -> Column:
    """Neighbours of query vertex ``u`` whose label is not among ``nlabels``."""
    wanted = _at([F.array(*[F.lit(q.labels[w]) for w in q.neighbours(u)]).cast("array<string>") for u in range(q.size)])
    return F.size(F.filter(wanted, lambda x: ~F.array_contains(F.col("nlabels"), x)))


def may_hold(q: QueryGraph, threshold: int) -> Column:
    """Whether a row with ``u, labels, nlabels, degree`` passes the label, degree and neighbour-label bounds."""
    t = q.clamp(threshold)
    return F.array_contains("labels", _at([F.lit(x) for x in q.labels])) & (degree_bound(q) <= t) & (label_bound(q) <= t)


def index_candidates(g: GraphView, q: QueryGraph, threshold: int) -> DataFrame:
    """``u, vid``: what a descent through two levels of blocks leaves.  The synopses are made once; every level reads them.

    A block holds one label, so blocks of labels that the query lacks would never be entered and are not made.
    """
    leaf = write_shared(g.vtx.sparkSession, vertex_synopsis(g, q.labels), "synopses")[0]
    placed = blocks(leaf).withColumn("labels", F.array("label")).withColumn("upper", F.floor(F.col("block") / FAN))
    low = roll_up(placed, "label", "upper", "block")
    high = roll_up(low, "label", "upper")
    u = g.vtx.sparkSession.range(q.size).select(F.col("id").cast("int").alias("u"))
    ok = may_hold(q, threshold)
    top = high.crossJoin(F.broadcast(u)).where(ok).select("u", "label", "upper")  # blocks times the query's vertices
    middle = low.join(top, ["label", "upper"]).where(ok).select("u", "label", "block")
    return placed.join(middle, ["label", "block"]).where(ok).select("u", "vid")
