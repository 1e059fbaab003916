"""The branch tree: every mapping once, by an include/exclude choice per frontier edge.

A node of the tree has mapped vertices ``S`` and excluded edges ``X``.  Its frontier are the undecided edges from S
to the rest, in some order; branch ``i`` excludes the first ``i - 1`` and maps a new vertex along the ``i``-th.  Excluded
edges count as missing when they are excluded and must be absent when both their ends are mapped; the
other edges a new vertex closes are counted if absent.  Bridges are never excluded.  The tree depends on the order
alone, not on data, so it is one plan: joins along edges, left joins that close edges, and UNION ALL.

The last vertex may be deferred: its candidates stay an array per partial mapping, with their missing edges, split
by that cost if asked, and are expanded (or only counted) at the end.
"""
from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mappings import injective, m
from ..operators.graph import GraphView
from .config import MatchConfig
from .query import Edge, QueryGraph, edge

Weight = Callable[[Edge], float]


class Branches:
    def __init__(self, g: GraphView, q: QueryGraph, threshold: int, config: MatchConfig, weight: Weight, size_of: Callable[[int], float], candidates: DataFrame | None = None):
        self.g, self.q, self.t, self.config, self.weight, self.size_of, self.candidates = g, q, q.clamp(threshold), config, weight, size_of, candidates
        self.bridges = q.bridges()
        self.leaves: list[DataFrame] = []
        self.buckets: list[DataFrame] = []
        self.random = random.Random(config.seed)

    # the order of a node's frontier

    def frontier(self, s: tuple[int, ...], x: frozenset[Edge], tree: list[Edge] | None) -> list[Edge]:
        """Undecided edges from ``s``: at most one more than may still be excluded, none after a bridge."""
        edges = [e for e in self.q.edges if e not in x and (e[0] in s) != (e[1] in s)]
        if tree is not None:
            edges = [next(e for e in tree if e in edges)]
        elif self.config.order == "random":
            self.random.shuffle(edges)
        else:
            inner = lambda e: sum(w in s for w in self.q.neighbours(e[0] if e[1] in s else e[1]))
            live = (lambda e: 0) if self.config.order == "static" else (lambda e: -inner(e))
            edges.sort(key=lambda e: (self.weight(e), live(e), e))
        out = []
        for e in edges[: self.t - len(x) + 1]:
            out.append(e)
            if e in self.bridges or not self.reachable(s, x | set(out)):
                break  # excluding it as well would cut the query
        return out

    def reachable(self, s: tuple[int, ...], x: frozenset[Edge] | set[Edge]) -> bool:
        return self.q.connected([e for e in self.q.edges if e not in x])

    # rows

    def start(self) -> tuple[int, DataFrame]:
        root = min(range(self.q.size), key=lambda u: (self.size_of(u) / max(1, self.q.degree(u)), u))
        rows = self.g.with_label(self.q.labels[root], m(root))
        return root, self.filtered(rows, root).withColumn("cost", F.lit(0))

    def filtered(self, rows: DataFrame, u: int) -> DataFrame:
        if self.candidates is None:
            return rows
        return rows.join(self.candidates.where(F.col("u") == u).select(F.col("vid").alias(m(u))), m(u), "left_semi")

    def close(self, rows: DataFrame, u: int, others: list[int], x: frozenset[Edge]) -> DataFrame:
        """Count or forbid the edges between the new vertex and mapped vertices."""
        for w in others:
            e, there = edge(u, w), self.g.edges_between(self.q.labels[u], self.q.labels[w], m(u), m(w))
            if e in x:
                rows = rows.join(there, [m(u), m(w)], "left_anti")
            else:
                rows = rows.join(there.withColumn("here", F.lit(0)), [m(u), m(w)], "left").withColumn("cost", F.col("cost") + F.coalesce("here", F.lit(1))).drop("here")
        return rows

    def extend(self, rows: DataFrame, s: tuple[int, ...], a: int, u: int, x: frozenset[Edge]) -> DataFrame:
        out = rows.join(self.g.edges_between(self.q.labels[a], self.q.labels[u], m(a), m(u)), m(a)).where(injective(self.q, u, list(s)))
        out = self.close(self.filtered(out, u), u, [w for w in self.q.neighbours(u) if w in s and w != a], x)
        return out.where(F.col("cost") + len(x) <= self.t)

    def deferred(self, rows: DataFrame, s: tuple[int, ...], u: int, x: frozenset[Edge]) -> DataFrame:
        """The last vertex's candidates per partial mapping: ``bucket`` of ``(v, delta)``."""
        anchors = [w for w in self.q.neighbours(u) if w in s]
        open_ = [w for w in anchors if edge(u, w) not in x]
        have = [*(m(w) for w in s), "cost"]
        ways = [rows.join(self.g.edges_between(self.q.labels[w], self.q.labels[u], m(w), m(u)), m(w)).select(*have, m(u)) for w in open_]
        hits = reduce(DataFrame.unionAll, ways).groupBy(*have, m(u)).agg(F.count(F.lit(1)).alias("hits"))
        found = hits.where(injective(self.q, u, list(s))).withColumn("delta", (F.lit(len(open_)) - F.col("hits")).cast("int"))
        found = self.close(self.filtered(found, u), u, [w for w in anchors if edge(u, w) in x], x).where(F.col("cost") + F.col("delta") + len(x) <= self.t)
        return found.groupBy(*have).agg(F.collect_list(F.struct(F.col(m(u)).alias("v"), "delta")).alias("bucket"))

    def split(self, buckets: DataFrame, s: tuple[int, ...]) -> DataFrame:
        """Buckets of one cost each, which is charged once: ``bucket`` of candidates, ``delta``."""
        have = [*(m(w) for w in s), "cost"]
        return buckets.select(*have, F.explode("bucket").alias("b")).groupBy(*have, F.col("b.delta").alias("delta")).agg(F.collect_list("b.v").alias("bucket"))

    def defers(self, s: tuple[int, ...], u: int) -> bool:
        """Defer if the policy says so; ``auto`` defers a vertex with several ways to it, where buckets save branches."""
        return self.config.defer == "always" or (self.config.defer == "auto" and sum(w in s for w in self.q.neighbours(u)) > 1)

    def grow(self, rows: DataFrame, s: tuple[int, ...], x: frozenset[Edge], tree: list[Edge] | None) -> None:
        if len(s) == self.q.size:
            self.leaves.append(self.done(rows.withColumn("missing", F.col("cost") + len(x))))
            return
        rest = [u for u in range(self.q.size) if u not in s]
        if len(rest) == 1 and tree is None and self.defers(s, rest[0]):
            u, buckets = rest[0], self.deferred(rows, s, rest[0], x)
            if self.config.cost_split:
                split = self.split(buckets, s)
                self.buckets.append(split.select(F.size("bucket").alias("n"), (F.col("cost") + F.col("delta") + len(x)).cast("int").alias("missing")))
                self.leaves.append(self.done(split.select(*(m(w) for w in s), (F.col("cost") + F.col("delta") + len(x)).alias("missing"), F.explode("bucket").alias(m(u)))))
            else:
                self.buckets.append(buckets.select(F.size("bucket").alias("n"), F.lit(None).cast("int").alias("missing")))
                out = buckets.select(*(m(w) for w in s), "cost", F.explode("bucket").alias("b"))
                self.leaves.append(self.done(out.select(*(m(w) for w in s), F.col("b.v").alias(m(u)), (F.col("cost") + F.col("b.delta") + len(x)).alias("missing"))))
            return
        excluded: frozenset[Edge] = x
        for e in self.frontier(s, x, tree):
            if len(excluded) > self.t:
                return
            a, u = e if e[0] in s else (e[1], e[0])
            self.grow(self.extend(rows, s, a, u, excluded), (*s, u), excluded, tree)
            if e in self.bridges:
                return
            excluded = excluded | {e}
        if tree is not None and len(excluded) <= self.t:  # replace the excluded tree edge
            within = [e for e in tree if e[0] in s and e[1] in s]
            new = self.q.spanning_tree(self.weight, excluded, within, s[0])
            if new is not None:
                self.grow(rows.where(F.col("cost") + len(excluded) <= self.t), s, excluded, new)

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[m(u) for u in range(self.q.size)], F.col("missing").cast("int").alias("missing"))

    def plan(self) -> DataFrame:
        root, rows = self.start()
        tree = self.q.spanning_tree(self.weight, root=root) if self.config.strategy == "tree" else None
        self.grow(rows, (root,), frozenset(), tree)
        return reduce(DataFrame.unionByName, self.leaves)

    def count(self) -> DataFrame:
        """``missing, matches`` without expanding split buckets; other leaves are counted as rows."""
        rows = self.plan()
        if self.config.cost_split and len(self.buckets) == len(self.leaves):
            return reduce(DataFrame.unionByName, self.buckets).groupBy("missing").agg(F.sum("n").cast("long").alias("matches"))
        return rows.groupBy("missing").agg(F.count(F.lit(1)).alias("matches"))
