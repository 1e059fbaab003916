import random

import pytest

from graphloom.plans.config import VARIANTS, MatchConfig
from graphloom.plans.query import PATTERNS, QueryGraph, brute_force, pattern, subset_count


def test_terminal_counts():
    expected = {"path3": [1], "triangle": [1, 3], "square": [1, 4], "tailed_triangle": [1, 3], "diamond": [1, 5, 8], "k4": [1, 6, 15, 16], "house": [1, 6, 11], "bowtie": [1, 6, 9]}
    for name, counts in expected.items():
        q = pattern(name, "A" * PATTERNS[name][0])
        assert q.cycle_rank == len(counts) - 1
        assert [len(q.terminals(t)) for t in range(len(counts))] == counts
        assert [len(x) for x in q.lattice(9)] == counts


def test_bridges_and_errors():
    assert pattern("tailed_triangle", "AAAA").bridges() == {(2, 3)}
    assert pattern("path3", "AAA").bridges() == {(0, 1), (1, 2)}
    assert QueryGraph.of("AB", [(1, 0), (0, 1), (0, 0)]).edges == ((0, 1),)
    for labels, edges in (("", []), ("AB", []), ("ABC", [(0, 1)]), ("A", [(0, 1)])):
        with pytest.raises(ValueError):
            QueryGraph.of(labels, edges)
    with pytest.raises(ValueError):
        pattern("triangle", "AAA").clamp(-1)


def test_minimal_seeds_and_fragments():
    q = pattern("house", "ABCDE")
    for t in range(3):
        terminals = q.terminals(t)
        assert set(terminals) <= q.minimal(t)
        seeds = q.seeds(t)
        assert set(seeds) == set(terminals)
        assert all(set(b) <= set(x) and len(b) == len(x) - 1 for x, b in seeds.items())
        fragments = q.decompose(q.edges, t, lambda whole, a, b: 1)
        assert sorted(e for f in fragments for e in f) == list(q.edges)
        assert len(fragments) == 1 or all(len(f) > t for f in fragments)
    assert subset_count(4, 2) == 11


def test_spanning_tree_avoids_edges():
    q = pattern("k4", "AAAA")
    tree = q.spanning_tree(lambda e: e[0], frozenset({(0, 1)}))
    assert len(tree) == 3 and (0, 1) not in tree and q.connected(tree)
    assert q.spanning_tree(lambda e: 0, frozenset({(0, 1), (0, 2), (0, 3)})) is None


def test_brute_force_monotone():
    rng = random.Random(1)
    edges = {(a, b) for a in range(6) for b in range(a + 1, 6) if rng.random() < 0.5}
    labels = {v: rng.choice("AB") for v in range(6)}
    q = pattern("diamond", "ABAB")
    found = [set(x for x, _ in brute_force(q, labels, edges, t)) for t in range(4)]
    assert found[0] <= found[1] <= found[2] == found[3]


def test_config():
    assert len(VARIANTS) == 11
    for bad in ({"strategy": "x"}, {"limit": -1}, {"cost_split": True}, {"strategy": "tree", "defer": "always"}, {"spoke_filter": True}):
        with pytest.raises(ValueError):
            MatchConfig(**bad)
