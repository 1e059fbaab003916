"""Enumeration over given candidates: every mapping along the spanning tree that its own preserved edges grow.

``bruteforce`` takes every vertex of the right label; ``index`` takes those that the synopsis index leaves.  The edges that a mapping
preserves connect the query, so growing from the first vertex of the order, always along the first preserved edge that
leaves the tree, reaches every vertex.  Each tree that some set of preserved edges within the budget grows is enumerated once, by
joins along its edges; its other edges are looked up as soon as both ends are mapped, and a row stays while they
are part of a set that grows this very tree.  So each mapping comes from one tree, and no vertex is joined without a key.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mappings import injective, m, missing_of
from ..operators.graph import GraphView
from .query import Edge, QueryGraph, edge


def grown_trees(q: QueryGraph, threshold: int, order: list[int]) -> dict[tuple[Edge, ...], list[int]]:
    """Trees in the order they grow, each with the masks of preserved edges that grow it."""
    at = {u: i for i, u in enumerate(order)}
    rank = lambda e: sorted((at[e[0]], at[e[1]]), reverse=True)
    out: dict[tuple[Edge, ...], list[int]] = {}
    for kept in (p for level in q.lattice(threshold) for p in level):
        tree, seen = [], {order[0]}
        while len(seen) < q.size:
            tree.append(min((e for e in kept if (e[0] in seen) != (e[1] in seen)), key=rank))
            seen |= set(tree[-1])
        out.setdefault(tuple(tree), []).append(q.mask(kept))
    return out


def enumerate_all(g: GraphView, q: QueryGraph, threshold: int, order: list[int], candidates: dict[int, DataFrame]) -> DataFrame:
    """``candidates``: per query vertex ``m{u}``."""
    parts = []
    for tree, masks in grown_trees(q, threshold, order).items():
        rows, done, known = candidates[order[0]].withColumn("mask", F.lit(0).cast("long")), [order[0]], 0
        for e in tree:
            a, u = e if e[0] in done else (e[1], e[0])
            rows = rows.join(g.edges_between(q.labels[a], q.labels[u], m(a), m(u)), m(a)).where(injective(q, u, done)).join(candidates[u], m(u), "left_semi")
            rows = rows.withColumn("mask", F.col("mask") + q.mask([e]))
            for w in [w for w in q.neighbours(u) if w in done and w != a]:
                there = g.edges_between(q.labels[w], q.labels[u], m(w), m(u)).withColumn("bit", F.lit(q.mask([edge(u, w)])).cast("long"))
                rows = rows.join(there, [m(w), m(u)], "left").withColumn("mask", F.col("mask") + F.coalesce("bit", F.lit(0))).drop("bit")
            done.append(u)
            known |= q.mask(x for x in q.edges if x[0] in done and x[1] in done)
            rows = rows.where(F.col("mask").isin(sorted({x & known for x in masks})))
        parts.append(rows.select(*[m(u) for u in range(q.size)], missing_of(F.col("mask"), q).alias("missing")))
    return reduce(DataFrame.unionAll, parts)
