"""Candidate filters: which data vertices each query vertex may map to, as ``cand(u, vid)``.

Every filter only removes vertices that occur in no mapping, so results do not depend on them.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Edge, QueryGraph, edge
from ..shared import drop_shared, write_shared
from .graph import GraphView
from .stats import degrees, neighbour_labels

#: Candidates up to which a round of the spoke filter broadcasts them; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def by_label(g: GraphView, q: QueryGraph) -> DataFrame:
    u = g.vtx.sparkSession.createDataFrame(list(enumerate(q.labels)), "u int, label string")
    return g.vtx.join(F.broadcast(u), "label").select("u", "vid")  # one row per query vertex


def _needs(q: QueryGraph, edges: tuple[Edge, ...]) -> list[tuple[int, str, int]]:
    out: dict[tuple[int, str], int] = {}
    for a, b in edges:
        for u, w in ((a, b), (b, a)):
            out[u, q.labels[w]] = out.get((u, q.labels[w]), 0) + 1
    return [(u, x, n) for (u, x), n in sorted(out.items())]


def by_degree(g: GraphView, q: QueryGraph, threshold: int, cand: DataFrame | None = None) -> DataFrame:
    """Query degree at most the data degree plus the budget; with budget 0 the exact degree filter."""
    t = q.clamp(threshold)
    need = F.element_at(F.array(*[F.lit(q.degree(u)) for u in range(q.size)]), F.col("u") + 1)
    return (cand or by_label(g, q)).join(degrees(g), "vid").where(need <= F.col("degree") + t).select("u", "vid")


def by_neighbour_labels(g: GraphView, q: QueryGraph, threshold: int, bridges: bool = False, pattern: tuple[Edge, ...] | None = None, cand: DataFrame | None = None) -> DataFrame:
    """The sum over labels of neighbours lacking is at most the budget; with ``bridges``, bridge neighbours may not lack.

    ``pattern``: the edges to look at, with budget 0 exact containment.
    """
    spark, t = g.vtx.sparkSession, q.clamp(threshold)
    edges = q.edges if pattern is None else pattern
    need = _needs(q, edges)
    held = {(u, x): n for u, x, n in _needs(q, tuple(e for e in edges if e in q.bridges()))} if bridges else {}
    if not need:
        return cand or by_label(g, q)
    table = spark.createDataFrame([(u, x, n, held.get((u, x), 0)) for u, x, n in need], "u int, label string, need int, held int")
    rows = (cand or by_label(g, q)).join(F.broadcast(table), "u").join(neighbour_labels(g), ["vid", "label"], "left")  # one row per query vertex and label
    have = F.coalesce("n", F.lit(0))
    lack = rows.groupBy("u", "vid").agg(F.sum(F.greatest(F.lit(0), F.col("need") - have)).alias("lack"), F.bool_and(F.col("held") <= have).alias("ok"))
    out = lack.where((F.col("lack") <= t) & F.col("ok")).select("u", "vid")
    alone = [u for u in range(q.size) if u not in {u for u, _, _ in need}]
    return out.unionByName((cand or by_label(g, q)).where(F.col("u").isin(alone))) if alone else out


def deficits(g: GraphView, q: QueryGraph) -> DataFrame:
    """``u, vid, lack``: neighbours by label that each vertex lacks for each query vertex."""
    table = g.vtx.sparkSession.createDataFrame(_needs(q, q.edges), "u int, label string, need int")
    rows = by_label(g, q).join(F.broadcast(table), "u").join(neighbour_labels(g), ["vid", "label"], "left")
    return rows.groupBy("u", "vid").agg(F.sum(F.greatest(F.lit(0), F.col("need") - F.coalesce("n", F.lit(0)))).cast("long").alias("lack"))


def _served(g: GraphView, cand: DataFrame, arcs: list[Edge]) -> DataFrame:
    """The candidates of each ``u`` that have, for every arc ``(u, w)``, a neighbour among the candidates of ``w``."""
    spark = g.vtx.sparkSession
    table = spark.createDataFrame(arcs, "u int, w int")
    wants = spark.createDataFrame([(u, sum(a == u for a, _ in arcs)) for u in sorted({u for u, _ in arcs})], "u int, wants int")
    other = cand.select(F.col("u").alias("w"), F.col("vid").alias("dst"))
    near = cand.join(F.broadcast(table), "u").join(g.typed.select(F.col("src").alias("vid"), "dst"), "vid").join(other, ["w", "dst"])  # arcs: the query's edges
    full = near.groupBy("u", "vid").agg(F.count_distinct("w").alias("n")).join(F.broadcast(wants), "u").where("n = wants").select("u", "vid")
    return full.unionByName(cand.where(~F.col("u").isin([u for u, _ in arcs])))


def by_bridge_support(g: GraphView, q: QueryGraph, cand: DataFrame) -> DataFrame:
    """Drop candidates without a neighbour among the candidates across a bridge.

    Bridges form a forest, so one pass from the leaves to the roots and one back reach the fixpoint.  A pass does all
    bridges of one depth at once; candidates are written to the shared folder between, so plans stay small.
    """
    bridges = sorted(q.bridges())
    if not bridges:
        return cand
    spark, depth, arcs = g.vtx.sparkSession, {}, []
    for root in range(q.size):  # breadth first over the forest
        todo = [] if root in depth else [root]
        depth.setdefault(root, 0)
        while todo:
            u = todo.pop(0)
            for w in q.neighbours(u, bridges):
                if w not in depth:
                    depth[w] = depth[u] + 1
                    arcs.append((u, w))
                    todo.append(w)
    levels = [[a for a in arcs if depth[a[0]] == d] for d in range(max(depth.values()))]
    old = None
    for step in [*reversed(levels), *([(w, u) for u, w in level] for level in levels)]:
        cand, path = write_shared(spark, _served(g, cand, step), "candidates")
        if old:
            drop_shared(spark, old)
        old = path
    return cand


def _hall_sets(q: QueryGraph, threshold: int) -> list[tuple[int, int, int]]:
    """``(u, set of neighbours as bits, neighbours of a candidate that must serve any of them)``, sets that need none left out."""
    t, bridges, out = q.clamp(threshold), q.bridges(), []
    for u in range(q.size):
        nbrs = q.neighbours(u)
        for k in range(1, len(nbrs) + 1):
            for c in combinations(range(len(nbrs)), k):
                least = k - (0 if all(edge(u, nbrs[i]) in bridges for i in c) else min(t, len(nbrs) - 1))
                if least > 0:
                    out.append((u, sum(1 << i for i in c), least))
    return out


def by_spokes(g: GraphView, q: QueryGraph, threshold: int, cand: DataFrame) -> DataFrame:
    """Neighbours of u must match distinct neighbours of v among their candidates, but for the budget (bridges always).

    By Hall's theorem: no set of neighbours of u may outnumber the neighbours of v that serve any of them by more than
    the budget, and no set of bridge neighbours at all.  Neighbours of v carry a bit mask of whom they serve; one
    aggregation checks all sets of all query vertices.  Repeated until nothing is removed; a round reads
    the candidates that the one before wrote to the shared folder, so its plan is the same however many came before.
    """
    spark = g.vtx.sparkSession
    sets = _hall_sets(q, threshold)
    if not sets:
        return cand
    arcs = spark.createDataFrame([(u, w, 1 << i) for u in range(q.size) for i, w in enumerate(q.neighbours(u))], "u int, w int, bit int")
    wanted = spark.createDataFrame(sets, "u int, set int, least int")
    total = spark.createDataFrame([(u, sum(x == u for x, _, _ in sets)) for u in sorted({u for u, _, _ in sets})], "u int, sets int")
    free = [u for u in range(q.size) if all(x != u for x, _, _ in sets)]
    edges = g.typed.select(F.col("src").alias("vid"), "dst")
    cand, old = write_shared(spark, cand, "candidates")
    before = cand.count()
    while True:
        serve = cand.select(F.col("u").alias("w"), F.col("vid").alias("dst")).join(F.broadcast(arcs), "w")  # arcs: the query's edges
        serve = serve.groupBy("u", "dst").agg(F.bit_or("bit").alias("mask"))
        small = F.broadcast if before * max(map(q.degree, range(q.size))) <= BROADCAST_ROWS else (lambda df: df)  # counted: two numbers a row
        near = edges.join(small(cand), "vid").join(small(serve), ["u", "dst"]).groupBy("u", "vid", "mask").agg(F.count(F.lit(1)).alias("n"))
        counted = near.join(F.broadcast(wanted), "u").where(F.col("mask").bitwiseAND(F.col("set")) != 0)
        met = counted.groupBy("u", "vid", "set", "least").agg(F.sum("n").alias("n")).where("n >= least")
        left = met.groupBy("u", "vid").agg(F.count(F.lit(1)).alias("met")).join(F.broadcast(total), "u").where("met = sets").select("u", "vid")
        left = left.unionByName(cand.where(F.col("u").isin(free))) if free else left
        cand, path = write_shared(spark, left, "candidates")
        drop_shared(spark, old)
        after, old = cand.count(), path
        if after == before:
            return cand
        before = after


def counts(cand: DataFrame) -> DataFrame:
    return cand.groupBy("u").agg(F.count(F.lit(1)).alias("candidates"))


def pipeline(g: GraphView, q: QueryGraph, threshold: int, bridge_filter: bool = False, spoke_filter: bool = False) -> DataFrame:
    """Degree, bridge-aware neighbour labels, then the filters asked for."""
    cand = by_neighbour_labels(g, q, threshold, bridges=True, cand=by_degree(g, q, threshold))
    if bridge_filter:
        cand = by_bridge_support(g, q, write_shared(g.vtx.sparkSession, cand, "candidates")[0])
    return by_spokes(g, q, threshold, cand) if spoke_filter else cand
