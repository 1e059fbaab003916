"""Statistics of a graph and of candidates: frames that plans and reports read."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Edge, QueryGraph
from .graph import GraphView


def degrees(g: GraphView) -> DataFrame:
    """``vid, degree`` of every vertex, isolated ones included."""
    d = g.edge.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
    return g.vtx.select("vid").join(d, "vid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def label_frequency(g: GraphView) -> DataFrame:
    return g.vtx.groupBy("label").agg(F.count(F.lit(1)).alias("vertices"))


def edge_label_frequency(g: GraphView) -> DataFrame:
    """``label_a, label_b, edges``: directed edges per pair of labels (an undirected edge counts under both orders)."""
    return g.typed.groupBy(F.col("sl").alias("label_a"), F.col("dl").alias("label_b")).agg(F.count(F.lit(1)).alias("edges"))


def neighbour_labels(g: GraphView) -> DataFrame:
    """``vid, label, n``: how many neighbours of each label a vertex has."""
    return g.typed.groupBy(F.col("src").alias("vid"), F.col("dl").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def selectivity(g: GraphView) -> DataFrame:
    """``label_a, label_b, selectivity``: the share of ordered vertex pairs that are edges."""
    n = label_frequency(g)
    a = n.select(F.col("label").alias("label_a"), F.col("vertices").alias("na"))
    b = n.select(F.col("label").alias("label_b"), F.col("vertices").alias("nb"))
    pairs = F.when(F.col("label_a") == F.col("label_b"), F.col("na") * (F.col("nb") - 1)).otherwise(F.col("na") * F.col("nb"))
    return edge_label_frequency(g).join(a, "label_a").join(b, "label_b").select("label_a", "label_b", (F.col("edges") / pairs).alias("selectivity"))


def selectivity_range(g: GraphView, q: QueryGraph) -> DataFrame:
    """The least, mean and largest selectivity among the query's edges."""
    known = selectivity(g)
    pairs = g.vtx.sparkSession.createDataFrame([(q.labels[a], q.labels[b]) for a, b in q.edges], "label_a string, label_b string")
    s = F.coalesce("selectivity", F.lit(0.0))
    return pairs.join(known, ["label_a", "label_b"], "left").agg(F.min(s).alias("least"), F.avg(s).alias("mean"), F.max(s).alias("largest"))


def pair_support(g: GraphView, q: QueryGraph, cand: DataFrame) -> DataFrame:
    """``a, b, support``: candidate edges per query edge, from ``cand(u, vid)``."""
    return candidate_edges(g, q, cand).where("u < u2").groupBy(F.col("u").alias("a"), F.col("u2").alias("b")).agg(F.count(F.lit(1)).alias("support"))


def candidate_edges(g: GraphView, q: QueryGraph, cand: DataFrame) -> DataFrame:
    """``u, v, u2, v2``: the candidate adjacency index, for every query edge in both directions."""
    arcs = g.vtx.sparkSession.createDataFrame([x for a, b in q.edges for x in ((a, b), (b, a))], "u int, u2 int")
    one = cand.select("u", F.col("vid").alias("v")).join(F.broadcast(arcs), "u")  # the query's edges
    two = one.join(g.edge.select(F.col("src").alias("v"), F.col("dst").alias("v2")), "v")
    return two.join(cand.select(F.col("u").alias("u2"), F.col("vid").alias("v2")), ["u2", "v2"]).select("u", "v", "u2", "v2")


def edge_priority(g: GraphView, q: QueryGraph, cand: DataFrame) -> DataFrame:
    """``u, anchor, priority``: candidates of u times the pair's frequency over the label's."""
    arcs = g.vtx.sparkSession.createDataFrame([(u, a, q.labels[u], q.labels[a]) for e in q.edges for u, a in (e, e[::-1])], "u int, anchor int, label_a string, label_b string")
    counts = cand.groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    n = label_frequency(g).withColumnRenamed("label", "label_a")
    rows = arcs.join(counts, "u", "left").join(edge_label_frequency(g), ["label_a", "label_b"], "left").join(n, "label_a", "left")
    return rows.select("u", "anchor", F.coalesce(F.col("c") * F.col("edges") / F.col("vertices"), F.lit(0.0)).alias("priority"))


class PlanStatistics:
    """The few numbers a plan needs, collected once per graph: per label and per pair of labels of the query."""

    def __init__(self, g: GraphView, q: QueryGraph):
        wanted = sorted(set(q.labels))
        n = {r.label: r.vertices for r in label_frequency(g).where(F.col("label").isin(wanted)).collect()}
        pairs = edge_label_frequency(g).where(F.col("label_a").isin(wanted) & F.col("label_b").isin(wanted)).collect()
        e = {(r.label_a, r.label_b): r.edges for r in pairs}
        self.vertices = [n.get(x, 0) for x in q.labels]
        self.pairs = {x: e.get((q.labels[x[0]], q.labels[x[1]]), 0) for x in q.edges}
        self.same = {x: q.labels[x[0]] == q.labels[x[1]] for x in q.edges}

    def size_of(self, u: int) -> float:
        return self.vertices[u]

    def weight(self, e: Edge) -> float:
        """The edges an edge's two labels have: fewer come first."""
        return self.pairs[e]

    def selectivity(self, e: Edge) -> float:
        a, b = self.vertices[e[0]], self.vertices[e[1]]
        return self.pairs[e] / max(1, a * (b - 1) if self.same[e] else a * b)
