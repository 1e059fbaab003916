"""Lattice strategies: a mapping within the budget embeds some connected spanning subgraph with just enough edges.

``lattice`` matches shared base graphs exactly, derives each terminal from one by a restored edge or a leaf, looks up
the terminal's lacking edges, and keeps a mapping only under the first terminal that it embeds, so that UNION ALL suffices.
Where a step is expected to make many rows, its narrow side is broadcast and its wide side spread, so that
neither the few keys of hubs nor a shuffle of those rows hold it up.  ``fragment`` matches every pattern of the lattice as a hash join of fragment tables, or by
restoring an edge in a smaller pattern's table, and keeps a mapping only under the pattern whose missing
edges are exactly its own, so that patterns are disjoint and UNION ALL suffices.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mappings import injective, m, missing_of, present_mask, with_presence
from ..operators.graph import GraphView
from ..shared import write_shared
from .query import Edge, QueryGraph, edge, subset_count

Pattern = tuple[Edge, ...]
#: Expected rows from which a step is spread; rows up to which its other side is broadcast; expected rows a task.
LARGE, BROADCAST_ROWS, TASK_ROWS = 10_000_000, 1_000_000, 2_000_000


class Matcher:
    def __init__(self, g: GraphView, q: QueryGraph, size_of: Callable[[int], float], selectivity: Callable[[Edge], float]):
        self.g, self.q, self.size_of, self.selectivity = g, q, size_of, selectivity

    def edge_rows(self, e: Edge) -> DataFrame:
        return self.g.edges_between(self.q.labels[e[0]], self.q.labels[e[1]], m(e[0]), m(e[1]))

    def exact(self, pattern: Pattern) -> DataFrame:
        """All injective label-preserving maps of a connected pattern's vertices with all its edges present."""
        vertices = {v for e in pattern for v in e}
        order = self.q.match_order(pattern, self.size_of, vertices)
        rows = self.g.with_label(self.q.labels[order[0]], m(order[0]))
        for i, u in enumerate(order[1:], 1):
            anchors = [w for w in self.q.neighbours(u, pattern) if w in order[:i]]
            first = min(anchors, key=lambda w: (self.selectivity((min(u, w), max(u, w))), w))
            rows = self.extend(rows, order[:i], first, u, tuple(e for e in pattern if set(e) <= set(order[:i])))
            for w in anchors:
                if w != first:
                    rows = self.restore(rows, (u, w))
        return rows.select(*[m(u) for u in sorted(vertices)])

    def restore(self, rows: DataFrame, e: Edge) -> DataFrame:
        """The rows in which an edge is present."""
        return rows.join(self.edge_rows(e), [m(e[0]), m(e[1])], "left_semi")

    def leaf(self, rows: DataFrame, mapped: list[int], e: Edge, pattern: Pattern = ()) -> DataFrame:
        """Rows, of ``pattern``, extended along an edge to a vertex that they lack."""
        a, u = e if e[0] in mapped else (e[1], e[0])
        return self.extend(rows, mapped, a, u, pattern)

    def extend(self, rows: DataFrame, mapped: list[int], a: int, u: int, pattern: Pattern) -> DataFrame:
        there, e = self.edge_rows((a, u)), edge(a, u)
        expected = self.estimate((*pattern, e))
        if expected > LARGE and self.estimate((e,)) <= BROADCAST_ROWS:
            there = F.broadcast(there)
            if not pattern or self.estimate(pattern) <= LARGE:
                rows = rows.repartition(math.ceil(expected / TASK_ROWS), *rows.columns)
        return rows.join(there, m(a)).where(injective(self.q, u, mapped))

    def found(self, rows: DataFrame, pattern: Pattern, e: Edge) -> DataFrame:
        """Rows of a pattern with ``p_a_b``: whether one more edge is present."""
        name, there = f"p_{e[0]}_{e[1]}", self.edge_rows(e)
        if self.estimate(pattern) > LARGE:  # only the edges that close a mapping of the pattern, which are few where many rows lack one
            there = self.exact(tuple(sorted((*pattern, e)))).select(m(e[0]), m(e[1])).distinct()
            there = write_shared(self.g.vtx.sparkSession, there, "closing")[0]
            if there.count() <= BROADCAST_ROWS:
                there = F.broadcast(there)
        return rows.join(there.withColumn(name, F.lit(True)), [m(e[0]), m(e[1])], "left").withColumn(name, F.col(name).isNotNull())

    def estimate(self, pattern: Pattern) -> float:
        """Expected rows: label counts times selectivities."""
        out = 1.0
        for v in {v for e in pattern for v in e}:
            out *= max(self.size_of(v), 1)
        for e in pattern:
            out *= self.selectivity(e)
        return out

    def join_fragments(self, tables: list[tuple[frozenset[int], DataFrame, float]]) -> DataFrame:
        """Hash joins on shared query vertices, the pair of least estimated product first."""
        tables = list(tables)
        while len(tables) > 1:
            pairs = [(i, j) for i in range(len(tables)) for j in range(i) if tables[i][0] & tables[j][0]]
            i, j = min(pairs, key=lambda p: (tables[p[0]][2] * tables[p[1]][2], p))
            (a, x, n), (b, y, k) = tables[i], tables[j]
            rows = x.join(y, [m(v) for v in sorted(a & b)])
            for u in sorted(b - a):
                rows = rows.where(injective(self.q, u, sorted(a - b)))
            tables = [t for p, t in enumerate(tables) if p not in (i, j)] + [(a | b, rows, n * k)]
        return tables[0][1]


def lattice(g: GraphView, q: QueryGraph, threshold: int, matcher: Matcher) -> DataFrame:
    if len(q.edges) == 0:
        return g.with_label(q.labels[0], "m0").withColumn("missing", F.lit(0))
    tables: dict[Pattern, DataFrame] = {}
    parts, earlier = [], []
    for terminal, base in sorted(q.seeds(threshold).items()):
        if base not in tables:
            tables[base] = matcher.exact(base)
        rows, mapped = tables[base], sorted({v for e in base for v in e})
        for e in terminal:
            if e not in base:
                rows = matcher.restore(rows, e) if e[0] in mapped and e[1] in mapped else matcher.leaf(rows, mapped, e, base)
        mask, lacking = F.lit(q.mask(terminal)).cast("long"), [e for e in q.edges if e not in terminal]
        for e in lacking:
            rows = matcher.found(rows, terminal, e)
            mask = mask + F.when(F.col(f"p_{e[0]}_{e[1]}"), F.lit(q.mask([e]))).otherwise(F.lit(0))
        # of the masks that hold this terminal, those that hold none before it
        own = [x for x in (q.mask((*terminal, *more)) for n in range(len(lacking) + 1) for more in combinations(lacking, n)) if not any(x & y == y for y in earlier)]
        rows = rows.withColumn("mask", mask).where(F.col("mask").isin(own))
        parts.append(rows.select(*[m(u) for u in range(q.size)], missing_of(F.col("mask"), q).alias("missing")))
        earlier.append(q.mask(terminal))
    return reduce(DataFrame.unionByName, parts)


def canonical(rows: DataFrame, g: GraphView, q: QueryGraph, pattern: Pattern) -> DataFrame:
    """The rows whose preserved edges are exactly the pattern's."""
    lacking = [e for e in q.edges if e not in pattern]
    return reduce(lambda r, e: r.join(g.edges_between(q.labels[e[0]], q.labels[e[1]], m(e[0]), m(e[1])), [m(e[0]), m(e[1])], "left_anti"), lacking, rows)


def fragment(g: GraphView, q: QueryGraph, threshold: int, matcher: Matcher) -> DataFrame:
    if len(q.edges) == 0:
        return g.with_label(q.labels[0], "m0").withColumn("missing", F.lit(0))
    t = q.clamp(threshold)

    def gain(whole: Pattern, a: Pattern, b: Pattern) -> float:
        cost = lambda p: subset_count(len(p), t) * matcher.estimate(p)
        return cost(whole) - cost(a) - cost(b)

    fragments = q.decompose(q.edges, t, gain)
    locals_: dict[Pattern, DataFrame] = {}
    tables: dict[Pattern, DataFrame] = {}
    parts = []
    levels, minimal = q.lattice(t), q.minimal(t)
    for missing in range(t, -1, -1):
        for pattern in levels[missing]:
            if pattern in minimal:
                pieces = []
                for f in fragments:
                    left = [e for e in f if e in pattern]
                    while left:  # a fragment's local pattern may fall into components
                        vertices = q.reach(left[0][0], left)
                        piece = tuple(e for e in left if e[0] in vertices)
                        left = [e for e in left if e not in piece]
                        if piece not in locals_:
                            locals_[piece] = matcher.exact(piece)
                        pieces.append((frozenset(vertices), locals_[piece], matcher.estimate(piece)))
                tables[pattern] = matcher.join_fragments(pieces)
            else:
                below = [p for p in levels[missing + 1] if set(p) < set(pattern)]
                child = min(below, key=lambda p: (matcher.estimate(p), p))
                tables[pattern] = matcher.restore(tables[child], next(e for e in pattern if e not in child))
            parts.append(canonical(tables[pattern], g, q, pattern).select(*[m(u) for u in range(q.size)], F.lit(missing).alias("missing")))
    return reduce(DataFrame.unionByName, parts)


def canonical_counts(g: GraphView, q: QueryGraph, threshold: int, rows: DataFrame) -> DataFrame:
    """``mask, missing, matches``: mappings per set of preserved edges."""
    masked = with_presence(rows.drop("missing"), g, q, list(q.edges)).withColumn("mask", present_mask(q))
    return masked.groupBy("mask").agg(F.count(F.lit(1)).alias("matches")).select("mask", missing_of(F.col("mask"), q).alias("missing"), "matches")
