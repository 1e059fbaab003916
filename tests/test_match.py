import random

import pytest

from graphloom.functions.mappings import violations
from graphloom.operators import candidates
from graphloom.plans import index, lattice
from graphloom.plans.config import VARIANTS, MatchConfig
from graphloom.plans.match import match, match_counts
from graphloom.plans.query import QueryGraph, brute_force, pattern
from graphloom.sources.views import returned_together, trade
from tests.graphs import EDGES, LABELS, rows, view

GOLDENS = {
    ("triangle", "ABC"): [1, 6, 6], ("square", "ABAB"): [0, 4, 4], ("square", "ABCB"): [0, 4, 4],
    ("tailed_triangle", "ABCD"): [1, 6, 6], ("tailed_triangle", "ACBA"): [0, 5, 5],
}


@pytest.fixture(scope="module")
def toy(spark):
    return view(spark, LABELS, EDGES).check()


@pytest.mark.parametrize("case", GOLDENS, ids=lambda c: f"{c[0]}-{c[1]}")
def test_toy_goldens(toy, case):
    q = pattern(*case)
    for t, n in enumerate(GOLDENS[case]):
        got = rows(match(toy, q, t))
        assert got == sorted(brute_force(q, LABELS, EDGES, t))
        assert len(got) == n


@pytest.mark.parametrize("variant", VARIANTS)
def test_variants_agree(toy, variant):
    for q, t in ((pattern("triangle", "ABC"), 1), (pattern("tailed_triangle", "ACBA"), 1)):
        assert rows(match(toy, q, t, VARIANTS[variant])) == sorted(brute_force(q, LABELS, EDGES, t))


@pytest.mark.parametrize("config", [MatchConfig(), MatchConfig(strategy="tree"), MatchConfig(defer="always"), MatchConfig(order="random", seed=5), MatchConfig(strategy="fragment"), MatchConfig(strategy="lattice"), MatchConfig(strategy="index"), MatchConfig(candidates=True, bridge_filter=True)], ids=str)
def test_random_graphs(spark, config):
    rng = random.Random(11)
    for name, n, kinds, t in (("diamond", 6, "AB", 2), ("tailed_triangle", 7, "A", 1), ("bowtie", 6, "A", 1)):
        labels = {v * 10: rng.choice(kinds) for v in range(n)}  # ids need not be dense
        edges = {(a, b) for a in labels for b in labels if a < b and rng.random() < 0.5}
        q = pattern(name, [rng.choice(kinds) for _ in range(5 if name == "bowtie" else 4)])
        assert rows(match(view(spark, labels, edges), q, t, config)) == sorted(brute_force(q, labels, edges, t))


@pytest.mark.parametrize("config", [MatchConfig(strategy="bruteforce"), MatchConfig(strategy="index"), VARIANTS["afe_no_af"], VARIANTS["s3and_ssm"]], ids=str)
def test_enumeration_joins_along_edges(spark, config):
    """Candidates of thousands of vertices, whose pairs and triples could not all be made."""
    n = 6000
    labels = {v: "AAB"[v % 3] for v in range(n)}
    edges = {(v, v + 1) for v in range(n - 1)} | {(v, v + 2) for v in range(0, n - 2, 7)}
    g = view(spark, labels, edges)
    got = match(g, pattern("triangle", "AAB"), 1, config)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(got) == rows(match(g, pattern("triangle", "AAB"), 1))


def test_index_makes_its_synopses_once(spark):
    """The descent's levels read written synopses; none counts neighbour labels again."""
    rng = random.Random(8)
    labels = {v: rng.choice("ABCD") for v in range(120)}
    edges = {(a, b) for a in labels for b in labels if a < b and rng.random() < 0.02}
    q = pattern("diamond", "ABCA")
    got = index.index_candidates(view(spark, labels, edges), q, 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "collect_set(dl" not in plan
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in labels}
    lack = lambda u, v: max(q.degree(u) - len(near[v]), sum(q.labels[w] not in {labels[x] for x in near[v]} for w in q.neighbours(u)))
    assert sorted(map(tuple, got.collect())) == sorted((u, v) for u, x in enumerate(q.labels) for v in labels if labels[v] == x and lack(u, v) <= 1)


@pytest.mark.parametrize("config", [VARIANTS["s3and_ssm"], MatchConfig(strategy="index")], ids=["s3and_ssm", "index"])
def test_index_makes_blocks_of_the_query_labels(spark, monkeypatch, config):
    """Other labels' vertices count as neighbours, but get no synopses of their own."""
    rng = random.Random(9)
    labels = {v: rng.choice("ABCDEFGH") for v in range(60)}
    edges = {(a, b) for a in labels for b in labels if a < b and rng.random() < 0.2}
    made, write = [], index.write_shared
    monkeypatch.setattr(index, "write_shared", lambda *a: made.append(write(*a)) or made[-1])
    q = pattern("triangle", "AAB")
    assert rows(match(view(spark, labels, edges), q, 1, config)) == sorted(brute_force(q, labels, edges, 1))
    ((synopses, _),) = made
    near = {v: {labels[b if a == v else a] for a, b in edges if v in (a, b)} for v in labels}
    assert {r.vid: set(r.nlabels) for r in synopses.collect()} == {v: near[v] for v in labels if labels[v] in "AB"}


@pytest.mark.parametrize("large", [lattice.LARGE, 0])
def test_lattice_without_distinct(spark, monkeypatch, large):
    """Mappings are told apart by the terminals they embed, also where every step counts as large."""
    monkeypatch.setattr(lattice, "LARGE", large)
    monkeypatch.setattr(lattice, "TASK_ROWS", 50)
    rng = random.Random(3)
    labels = {v: rng.choice("AB") for v in range(9)}
    edges = {(a, b) for a in labels for b in labels if a < b and rng.random() < 0.6}
    g = view(spark, labels, edges)
    for name, kinds, t in (("tailed_triangle", "ABAB", 1), ("diamond", "AABB", 2)):
        q = pattern(name, kinds)
        got = match(g, q, t, MatchConfig(strategy="lattice"))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Aggregate" in x and "m0#" in x for x in plan.splitlines())
        assert rows(got) == sorted(brute_force(q, labels, edges, t))


def test_counts_without_expansion(toy):
    q = pattern("tailed_triangle", "ABCD")
    want = {}
    for _, missing in brute_force(q, LABELS, EDGES, 1):
        want[missing] = want.get(missing, 0) + 1
    for config in (MatchConfig(), MatchConfig(defer="always", cost_split=True), MatchConfig(strategy="lattice")):
        assert {r.missing: r.matches for r in match_counts(toy, q, 1, config).collect()} == want


def test_edge_cases(spark, toy):
    assert rows(match(toy, QueryGraph.of("A", []), 3)) == [((0,), 0), ((3,), 0)]
    assert rows(match(toy, QueryGraph.of(["A", "none"], [(0, 1)]), 0)) == []
    assert rows(match(toy, QueryGraph.of("ABCABCDA", [(i, i + 1) for i in range(7)]), 0)) == []
    assert match(toy, pattern("triangle", "ABC"), 1, MatchConfig(limit=2)).count() == 2
    empty = view(spark, {}, [])
    assert rows(match(empty, pattern("triangle", "ABC"), 1)) == []


def test_violations(spark, toy):
    q = pattern("triangle", "ABC")
    good = match(toy, q, 1)
    assert set(violations(good, toy, q, 1).first()) == {0}
    bad = spark.createDataFrame([(0, 1, 2, 0), (0, 1, 2, 0), (1, 1, 2, 0), (3, 1, 5, 0)], "m0 long, m1 long, m2 long, missing int")
    v = violations(bad, toy, q, 1).first().asDict()
    assert v["repeated"] == 1 and v["wrong_label"] == 1 and v["not_injective"] == 1 and v["disconnected"] >= 1 and v["over_budget"] >= 1


def test_candidates_hold_all_results(toy):
    q = pattern("tailed_triangle", "ABCD")
    plain = {tuple(r) for r in candidates.by_neighbour_labels(toy, q, 1).collect()}
    strict = {tuple(r) for r in candidates.by_neighbour_labels(toy, q, 1, bridges=True).collect()}
    bridge = {tuple(r) for r in candidates.by_bridge_support(toy, q, candidates.by_neighbour_labels(toy, q, 1, bridges=True)).collect()}
    spoke = {tuple(r) for r in candidates.by_spokes(toy, q, 1, candidates.by_label(toy, q)).collect()}
    used = {(u, v) for m, _ in brute_force(q, LABELS, EDGES, 1) for u, v in enumerate(m)}
    assert used <= bridge <= strict <= plain and used <= spoke


def test_checked_views(spark):
    with pytest.raises(ValueError):
        view(spark, {0: "A"}, [(0, 1)]).check()
    twice = view(spark, {0: "A"}, [])
    twice.vtx = twice.vtx.unionByName(spark.createDataFrame([(0, "B")], "vid long, label string"))
    with pytest.raises(ValueError):
        twice.check()


def test_goldens_of_tables(spark, sf_dir):
    g = returned_together(spark, sf_dir)
    assert g.edge.count() == 2440
    brands = [f"Brand#{i}" for i in range(1, 6)]
    assert match(g, pattern("triangle", [brands[0], brands[0], brands[1]]), 1).count() == 6
    assert match(g, pattern("square", brands[:4]), 1).count() == 4
    assert match(g, pattern("house", brands), 2).count() == 5
    h = trade(spark, sf_dir)
    assert h.edge.count() == 2506
    q = pattern("triangle", ["cust:BUILDING", "supplier", "nation"])
    assert [match(h, q, t).count() for t in (0, 1)] == [5, 495]


def spokes_by_hand(q, labels, edges, t, cand):
    """The fixpoint of the spoke rule, by trying all assignments of a candidate's neighbours."""
    nbr = lambda v: {b if a == v else a for a, b in edges if v in (a, b)}

    def best(u, v, cand, must):
        """The most query neighbours of u that distinct neighbours of v serve (``must``: all bridge ones among them)."""
        wanted = q.neighbours(u)

        def grow(i, used, n):
            if i == len(wanted):
                return n
            w = wanted[i]
            ways = [grow(i + 1, used | {x}, n + 1) for x in nbr(v) - used if (w, x) in cand]
            return max([*ways, -9 if must(w) else grow(i + 1, used, n)])

        return grow(0, set(), 0)

    t = q.clamp(t)
    while True:
        fixed = lambda u, w: tuple(sorted((u, w))) in q.bridges()
        left = {(u, v) for u, v in cand if best(u, v, cand, lambda w, u=u: fixed(u, w)) >= q.degree(u) - min(t, q.degree(u) - 1)}
        if left == cand:
            return cand
        cand = left


@pytest.mark.parametrize("name", ["diamond", "tailed_triangle"])
def test_spokes_against_enumeration(spark, name):
    rng = random.Random(name)
    q = pattern(name, [rng.choice("AB") for _ in range({"bowtie": 5, "path3": 3}.get(name, 4))])
    labels = {v: rng.choice("AB") for v in range(9)}
    edges = {(a, b) for a in labels for b in labels if a < b and rng.random() < 0.35}
    g = view(spark, labels, edges)
    for t in range(3):
        start = {(u, v) for u, x in enumerate(q.labels) for v, y in labels.items() if x == y}
        got = candidates.by_spokes(g, q, t, candidates.by_label(g, q))
        used = {(u, v) for m, _ in brute_force(q, labels, edges, t) for u, v in enumerate(m)}
        mine = {tuple(r) for r in got.collect()}
        # Hall's rule bounds bridge neighbours and all neighbours each for itself; one assignment must meet both.
        assert spokes_by_hand(q, labels, edges, t, start) <= mine and used <= mine
        if not q.bridges():
            assert mine == spokes_by_hand(q, labels, edges, t, start)
        assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 5000


def test_bridge_support_against_enumeration(spark):
    rng = random.Random(4)
    q = QueryGraph.of("ABABC", [(0, 1), (1, 2), (2, 3), (1, 4)])
    labels = {v: rng.choice("ABC") for v in range(14)}
    edges = {(a, b) for a in labels for b in labels if a < b and rng.random() < 0.2}
    g = view(spark, labels, edges)
    cand = {(u, v) for u, x in enumerate(q.labels) for v, y in labels.items() if x == y}
    joined = lambda a, b: (min(a, b), max(a, b)) in edges
    while True:
        left = {(u, v) for u, v in cand if all(any(w == x and joined(v, y) for x, y in cand) for w in q.neighbours(u))}
        if left == cand:
            break
        cand = left
    assert {tuple(r) for r in candidates.by_bridge_support(g, q, candidates.by_label(g, q)).collect()} == cand
