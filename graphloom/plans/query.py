"""Query graphs: the small pattern whose plan is made on the driver.

A pattern has labels for the vertices 0..k-1 and undirected simple edges.  Everything here works on
the pattern alone (tens of vertices at most), never on data.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

Edge = tuple[int, int]


def edge(u: int, v: int) -> Edge:
    return (u, v) if u < v else (v, u)


@dataclass(frozen=True)
class QueryGraph:
    labels: tuple[str, ...]
    edges: tuple[Edge, ...]

    @staticmethod
    def of(labels: Iterable[str], edges: Iterable[Edge]) -> QueryGraph:
        """Self loops are dropped and repeated or reversed edges count once."""
        labels = tuple(labels)
        kept = sorted({edge(*e) for e in edges if e[0] != e[1]})
        if any(not (0 <= u < len(labels) and v < len(labels)) for u, v in kept):
            raise ValueError("an edge names a vertex that the query does not have")
        q = QueryGraph(labels, tuple(kept))
        if not labels or not q.connected(q.edges):
            raise ValueError("the query is empty or disconnected")
        return q

    @property
    def size(self) -> int:
        return len(self.labels)

    @property
    def cycle_rank(self) -> int:
        return len(self.edges) - self.size + 1

    def neighbours(self, u: int, edges: Iterable[Edge] | None = None) -> list[int]:
        return sorted(b if a == u else a for a, b in (self.edges if edges is None else edges) if u in (a, b))

    def degree(self, u: int) -> int:
        return len(self.neighbours(u))

    def clamp(self, threshold: int) -> int:
        """The missing edges that can occur at all: at most the cycle rank."""
        if threshold < 0:
            raise ValueError("the threshold is negative")
        return min(threshold, self.cycle_rank)

    def reach(self, start: int, edges: Iterable[Edge]) -> set[int]:
        edges, seen, todo = list(edges), {start}, [start]
        while todo:
            new = set(self.neighbours(todo.pop(), edges)) - seen
            seen |= new
            todo += new
        return seen

    def connected(self, edges: Iterable[Edge], vertices: Iterable[int] | None = None) -> bool:
        vertices = set(range(self.size) if vertices is None else vertices)
        return bool(vertices) and vertices <= self.reach(min(vertices), edges)

    def bridges(self) -> frozenset[Edge]:
        """Edges without which the query falls apart; they can never be missing."""
        return frozenset(e for e in self.edges if not self.connected(x for x in self.edges if x != e))

    def mask(self, edges: Iterable[Edge]) -> int:
        """Edges as bits in the order of ``edges``."""
        return sum(1 << self.edges.index(e) for e in edges)

    def lattice(self, threshold: int) -> list[list[tuple[Edge, ...]]]:
        """Connected spanning subgraphs by the number of deleted edges, 0 to the clamped threshold."""
        return [[p for p in (tuple(e for e in self.edges if e not in gone) for gone in combinations(self.edges, d)) if self.connected(p)] for d in range(self.clamp(threshold) + 1)]

    def terminals(self, threshold: int) -> list[tuple[Edge, ...]]:
        return self.lattice(threshold)[-1]

    def connected_masks(self, threshold: int) -> list[int]:
        """Masks of preserved edges that keep the query connected within the budget."""
        return sorted(self.mask(p) for level in self.lattice(threshold) for p in level)

    def minimal(self, threshold: int) -> set[tuple[Edge, ...]]:
        """Patterns with no connected pattern one edge smaller in the lattice."""
        levels = self.lattice(threshold)
        out = set(levels[-1])
        for d, level in enumerate(levels[:-1]):
            below = {frozenset(p) for p in levels[d + 1]}
            out |= {p for p in level if not any(frozenset(p) - {e} in below for e in p)}
        return out

    def base_graphs(self, terminal: tuple[Edge, ...]) -> list[tuple[Edge, ...]]:
        """A terminal less one edge, connected but for at most one vertex left alone."""
        out = []
        for e in terminal:
            rest = tuple(x for x in terminal if x != e)
            used = {v for x in rest for v in x}
            if used and self.connected(rest, used) and len(used) >= self.size - 1:
                out.append(rest)
        return out

    def seeds(self, threshold: int) -> dict[tuple[Edge, ...], tuple[Edge, ...]]:
        """A greedy cover: for each terminal the base graph from which it is derived, few base graphs in all."""
        left, out = set(self.terminals(threshold)), {}
        options: dict[tuple[Edge, ...], set] = {}
        for t in left:
            for b in self.base_graphs(t) or [t]:
                options.setdefault(b, set()).add(t)
        while left:
            best = max(sorted(options), key=lambda b: len(options[b] & left))
            out |= {t: best for t in options[best] & left}
            left -= options[best]
        return out

    def spanning_tree(self, weight: Callable[[Edge], float], without: frozenset[Edge] = frozenset(), within: Iterable[Edge] = (), root: int = 0) -> list[Edge] | None:
        """Edges of a tree grown from ``root`` by least weight, containing ``within``; None if ``without`` cuts the query."""
        tree, seen, fixed = [], {root}, set(within)
        while len(seen) < self.size:
            ways = [e for e in self.edges if e not in without and (e[0] in seen) != (e[1] in seen)]
            if not ways:
                return None
            e = min(ways, key=lambda x: (x not in fixed, weight(x), x))
            tree.append(e)
            seen |= set(e)
        return tree

    def match_order(self, edges: Iterable[Edge], size_of: Callable[[int], float], vertices: Iterable[int] | None = None) -> list[int]:
        """A connected order: fewest candidates first, then most mapped neighbours, fewest candidates, highest degree."""
        edges = list(edges)
        left = set(range(self.size) if vertices is None else vertices)
        order = [min(left, key=lambda u: (size_of(u), -len(self.neighbours(u, edges)), u))]
        left -= set(order)
        while left:
            rank = lambda u: (-len(set(self.neighbours(u, edges)) & set(order)), size_of(u), -len(self.neighbours(u, edges)), u)
            order.append(min(left, key=rank))
            left -= {order[-1]}
        return order

    def decompose(self, edges: tuple[Edge, ...], threshold: int, gain: Callable[[tuple[Edge, ...], tuple[Edge, ...], tuple[Edge, ...]], float]) -> list[tuple[Edge, ...]]:
        """Fragments of more than ``threshold`` edges each: a balanced cut of the line graph's breadth-first order while it gains."""
        least, best = threshold + 1, None
        for start in edges:
            order, todo = [], [start]
            while todo:
                e = todo.pop(0)
                if e not in order:
                    order.append(e)
                    todo += [x for x in edges if x not in order and set(x) & set(e)]
            for cut in range(least, len(edges) - least + 1):
                a, b = tuple(sorted(order[:cut])), tuple(sorted(set(edges) - set(order[:cut])))
                if self.connected(a, {v for e in a for v in e}) and self.connected(b, {v for e in b for v in e}):
                    key = (gain(edges, a, b), -abs(len(a) - len(b)))
                    if best is None or key > best[0]:
                        best = (key, a, b)
        if best is None or best[0][0] <= 0:
            return [edges]
        return self.decompose(best[1], threshold, gain) + self.decompose(best[2], threshold, gain)


def subset_count(m: int, threshold: int) -> int:
    """Ways to delete at most ``threshold`` of ``m`` edges: the local patterns of a fragment."""
    return sum(comb(m, i) for i in range(min(m, threshold) + 1))


def brute_force(q: QueryGraph, labels: dict[int, str], edges: set[Edge], threshold: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """All mappings by plain enumeration, for tests."""
    t = q.clamp(threshold)

    def grow(m: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if len(m) == q.size:
            yield m
            return
        for v, label in labels.items():
            if label == q.labels[len(m)] and v not in m:
                yield from grow((*m, v))

    for m in grow(()):
        kept = [(a, b) for a, b in q.edges if edge(m[a], m[b]) in edges]
        if len(q.edges) - len(kept) <= t and q.connected(kept):
            yield m, len(q.edges) - len(kept)


#: Fixed query shapes by name.
PATTERNS: dict[str, tuple[int, tuple[Edge, ...]]] = {
    "path3": (3, ((0, 1), (1, 2))),
    "triangle": (3, ((0, 1), (1, 2), (0, 2))),
    "square": (4, ((0, 1), (1, 2), (2, 3), (0, 3))),
    "tailed_triangle": (4, ((0, 1), (1, 2), (0, 2), (2, 3))),
    "diamond": (4, ((0, 1), (1, 2), (2, 3), (0, 3), (0, 2))),
    "k4": (4, ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))),
    "house": (5, ((0, 1), (1, 2), (2, 3), (0, 3), (0, 4), (1, 4))),
    "bowtie": (5, ((0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4))),
}


def pattern(name: str, labels: Iterable[str]) -> QueryGraph:
    return QueryGraph.of(labels, PATTERNS[name][1])
